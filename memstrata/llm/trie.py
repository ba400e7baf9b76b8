"""Conversation prefix trie by the Euler-tour technique.

A node is a distinct sequence of first turns. Every node gives an enter arc
and an exit arc; the arcs in walking order are a linked list, known only by
each arc's successor. The list is ranked by pointer jumping, subtree totals
are then differences of prefix sums between an arc pair's positions.

Nodes are named by (smallest member, depth), which is exact: at one depth a
conversation belongs to one node. Sequences are compared by 120 bits: the
exclusive or of hashes of (place, turn), each from SHA-256, so that a long
conversation's prefixes come from split running aggregates and no task holds
a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memstrata.session import durable, numbered

from .common import table

GROUP = 100         # conversations that share the first turns of one
MOST_SHARED = 6     # a conversation takes fewer of them than this
SLOT = 1024         # turns of a conversation in one window
SIBLING_BITS = 12   # siblings in one window: 2 ** 12 at most, as their names differ
ENDS_BITS = 10      # ids in one text of the end lists: 2 ** 10 at most
MARKED = 64         # one arc of so many is a mark of the list ranking
TOUR_SLOT = 1 << 16  # arcs in one window of the prefix sums
NAME = ["conv_id", "depth"]
ARC = ["c", "d", "e"]
NEXT = ["nc", "nd", "ne"]


# sequences

def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position from 1, content, chars) of each row, texts already replaced by their digest."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("content"),
        F.char_length(text).cast("long").alias("chars"))
    slot = F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 62)))
    return numbered(rows, ["conv_id"], slot, [F.col("turn"), F.col("role"), F.col("content")]).select("conv_id", "position", "content", "chars")


def sharing(turns: DataFrame) -> DataFrame:
    """(conv_id, head, base, shared, length): every conversation takes the first ``head`` turns of ``base``, as far as it has them."""
    own = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    own = durable(own.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("head"),
                             (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    return (own.join(base, "base", "left").withColumn("shared", F.least("head", F.coalesce("there", F.lit(0).cast("long"))))
            .select("conv_id", "head", "base", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")))


def rebuild(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, content, chars, length) of the rebuilt conversations."""
    first = turns.where(F.col("position") < MOST_SHARED).withColumnRenamed("conv_id", "base")
    taken = (plan.where("shared > 0").join(first, "base").where("position <= head")
             .select("conv_id", F.col("position").alias("depth"), "content", "chars", "length"))
    rest = (turns.join(plan, "conv_id").where("position > head")
            .select("conv_id", (F.col("shared") + F.col("position") - F.col("head")).alias("depth"), "content", "chars", "length"))
    return taken.unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds the names of the sequence up to each row (x1, x2) and up to the one before it (p1, p2)."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("content")).cast("binary"), 256)
    bits = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = rows.withColumns({"v1": bits[0], "v2": bits[1], "slot": F.floor(F.col("depth") / SLOT)}).drop("content")
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shift = (rows.groupBy("conv_id", "slot").agg(F.bit_xor("v1").alias("s1"), F.bit_xor("v2").alias("s2"))
             .select("conv_id", "slot", F.bit_xor("s1").over(before).alias("s1"), F.bit_xor("s2").over(before).alias("s2")).where("slot > 0"))
    inside = Window.partitionBy("conv_id", "slot").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    run = [F.bit_xor(v).over(inside) for v in ("v1", "v2")]
    named = rows.select("*", run[0].alias("r1"), run[1].alias("r2")).join(shift, ["conv_id", "slot"], "left")
    named = named.withColumns({x: F.col(r).bitwiseXOR(F.coalesce(s, zero)) for x, r, s in (("x1", "r1", "s1"), ("x2", "r2", "s2"))})
    return named.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("v1")).alias("p1"),
                        F.col("x2").bitwiseXOR(F.col("v2")).alias("p2"), "chars", "length")


# nodes

def nodes_of(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, n_convs, chars, parent_conv_id) of each node; the root has no parent."""
    zero = F.lit(0).cast("long")
    inner = paths.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
                                                   F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = (plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("chars"),
                    F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2")))
    nodes = durable(inner.unionByName(root))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2")


def ends_of(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): hash of the ids, in order, of the conversations that end at a node.

    Ids are joined in runs of bounded size first; a task then reads the runs
    of its nodes in order and holds a hash state only.
    """
    zero = F.lit(0).cast("long")
    ends = (paths.where("depth = length").select("conv_id", "depth", "x1", "x2")
            .unionByName(plan.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"))))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    runs = ends.groupBy("depth", "x1", "x2", F.shiftright("conv_id", ENDS_BITS).alias("run")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "x1", "x2", "ids"))):
                if key == at:
                    state.update(b",")
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["depth", "x1", "x2", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, state.hexdigest())], names=["depth", "x1", "x2", "ends_sha256"])

    return (runs.repartition("depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "run").select("depth", "x1", "x2", "ids")
            .mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string"))


# tour

def families(nodes: DataFrame) -> DataFrame:
    """Adds n_children, first_child and next_sibling; siblings stand in the order of their names.

    A parent may have a third of all nodes as children: they are numbered in
    runs of neighbouring names, and the last of a run is followed by the
    first of the next.
    """
    run = F.shiftright("conv_id", SIBLING_BITS).alias("run")
    family = ["parent_conv_id", "depth"]
    kids = nodes.where("depth > 0").select(*NAME, "parent_conv_id", run)
    runs = kids.groupBy(*family, "run").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    later = runs.select(*family, "run", F.lead("first").over(Window.partitionBy(*family).orderBy("run")).alias("later")).where("later is not null")
    beside = (kids.withColumn("beside", F.lead("conv_id").over(Window.partitionBy(*family, "run").orderBy("conv_id")))
              .join(later, [*family, "run"], "left").select(*NAME, F.coalesce("beside", "later").alias("next_sibling")))
    below = (runs.groupBy(*family).agg(F.min("first").alias("first_child"), F.sum("n").alias("n_children"))
             .select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "first_child", "n_children"))
    return nodes.join(below, NAME, "left").join(beside, NAME, "left").fillna(0, ["n_children"])


def tour(tree: DataFrame) -> DataFrame:
    """The arcs (c, d, e: exit) with their successor (nc, nd, ne); the last one has none."""
    leaf, no = F.col("first_child").isNull(), F.lit(None)
    enter = tree.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(False).alias("e"),
                        F.coalesce("first_child", "conv_id").alias("nc"), F.when(leaf, F.col("depth")).otherwise(F.col("depth") + 1).alias("nd"), leaf.alias("ne"))
    more, top = F.col("next_sibling").isNotNull(), F.col("depth") == 0
    leave = tree.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(True).alias("e"),
                        F.coalesce("next_sibling", "parent_conv_id").alias("nc"),
                        F.when(top, no).when(more, F.col("depth")).otherwise(F.col("depth") - 1).cast("long").alias("nd"), F.when(top, no).otherwise(~more).alias("ne"))
    return enter.unionByName(leave)


def jump(links: DataFrame, done: Column) -> DataFrame:
    """Pointer jumping: every row not ``done`` takes over its successor's successor and adds up the distance, until all are done."""
    while not links.where(~done).isEmpty():
        for _ in range(2):
            ahead = links.select(*[F.col(a).alias(n) for a, n in zip(ARC, NEXT)], *[F.col(n).alias(f"_{n}") for n in NEXT], F.col("dist").alias("_dist"))
            moved = (links.where(~done).join(ahead, NEXT)
                     .select(*ARC, *[F.col(f"_{n}").alias(n) for n in NEXT], (F.col("dist") + F.col("_dist")).alias("dist")))
            links = links.where(done).unionByName(moved)
        links = durable(links)
    return links


def rank(arcs: DataFrame, marked: int = MARKED) -> DataFrame:
    """Position from 0 of each arc of the list.

    One arc of ``marked`` is a mark, by its hash. All arcs jump until they see
    a mark, which takes about log2(marked) rounds at any length, with fewer
    arcs in each; then the marks alone jump to the end.
    """
    is_mark = lambda names: F.pmod(F.xxhash64(*names), F.lit(marked)) == 0
    at_end = F.col("nc").isNull()
    links = durable(arcs.withColumn("dist", F.when(at_end, 0).otherwise(1).cast("long")))
    links = jump(links, at_end | is_mark(NEXT))
    marks = jump(links.where(is_mark(ARC)), at_end)
    rest = marks.select(*[F.col(a).alias(n) for a, n in zip(ARC, NEXT)], F.col("dist").alias("_rest"))
    togo = durable(links.join(rest, NEXT, "left").select(*ARC, (F.col("dist") + F.coalesce("_rest", F.lit(0))).alias("togo")))
    last = togo.agg(F.max("togo")).first()[0]
    return togo.select(*ARC, (F.lit(last) - F.col("togo")).alias("position"))


def subtree_sums(places: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """For each node, the sum of the values of its subtree: what the tour gathers between its enter and its exit."""
    arcs = places.join(values.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(False).alias("e"), *names), ARC, "left")
    arcs = durable(arcs.fillna(0, names).withColumn("slot", F.floor(F.col("position") / TOUR_SLOT)))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (arcs.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])
              .select("slot", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names]))
    inside = Window.partitionBy("slot").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    upto = (arcs.select(*ARC, "slot", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in names]).join(starts, "slot")
            .select(*ARC, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names]))
    signed = [F.sum(F.when(F.col("e"), F.col(n)).otherwise(-F.col(n))).cast("long").alias(n) for n in names]
    return upto.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(*signed)


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations, one row per node.

    Turns stand in the order of (turn, role, digest of role and text), null
    turns first, so repeated and tied rows have a defined order; a null role
    or text counts as an empty one. Rows without ``conv_id`` belong to no
    conversation. Other columns are not read, whatever their names. An empty
    table has no conversation and gives no node.
    """
    turns = durable(turn_rows(conversations, conv_id, turn, role, text))
    plan = durable(sharing(turns))
    paths = durable(prefixes(rebuild(turns, plan)))
    tree = durable(families(durable(nodes_of(paths, plan))))
    if tree.isEmpty():
        places = spark_empty(tree.sparkSession)
    else:
        places = rank(tour(tree))
    own = tree.select(*NAME, F.when(F.col("first_child").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
                      ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(places, own, ["n_leaves", "saved_tokens"])
    nothing = hashlib.sha256(b"").hexdigest()
    return (tree.join(sums, NAME).join(ends_of(paths, plan), ["depth", "x1", "x2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def spark_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "c long, d long, e boolean, position long")


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


OP13_SQL = """
WITH crc AS (
  SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS e
    FROM (SELECT unnest(range(256)) AS i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT conv_id, max(pos) AS n FROM turns GROUP BY 1), crc),
plan AS (
  SELECT a.conv_id, a.h, a.base, least(a.h, coalesce(b.n, 0)) AS m FROM convs a LEFT JOIN convs b ON a.base = b.conv_id),
rebuilt AS (
  SELECT p.conv_id, t.pos AS depth, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.h
  UNION ALL
  SELECT p.conv_id, p.m + t.pos - p.h, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h),
prefix AS (
  SELECT conv_id, depth, length(text) AS chars,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM plan),
member AS (
  SELECT conv_id, depth, chars, min(conv_id) OVER w AS node, count(*) OVER w AS n, depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM prefix WINDOW w AS (PARTITION BY depth, path)),
node AS (
  SELECT node, depth, any_value(n) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY 1, 2),
up AS (
  SELECT n.node, n.depth, m.node AS parent FROM node n LEFT JOIN member m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS k FROM up WHERE depth > 0 GROUP BY 1, 2),
sums AS (
  SELECT m.node, m.depth, sum((k.k IS NULL)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM node n LEFT JOIN kids k USING (node, depth) JOIN member m ON m.conv_id = n.node AND m.depth <= n.depth GROUP BY 1, 2)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, up.parent AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.k, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN up USING (node, depth) JOIN sums s USING (node, depth) LEFT JOIN kids k USING (node, depth)
"""
