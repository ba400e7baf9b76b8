"""Near-duplicate groups by a signature-coordinate inverted join.

Every different set of shingles gets a MinHash signature and is posted under
its coordinate-value pairs. Two sets of the wanted similarity collide in at
least ``threshold`` of the coordinates, so it is enough to post the rarest
``coordinates - threshold + 1`` of each (prefix); sets whose prefix pairs are
theirs alone meet nothing (skip). Each posting list is first merged with its
most central set alone; what that links is one component, and only lists
that still hold several components are compared further, block by block.
Candidates need the collision count or a shared block, and every link is
confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memstrata.session import broadcast_measured, durable

from .common import components, fresh, slices, stored_texts, table

COORDINATES = 64
MISS = 1e-6               # chance that a linked pair collides in fewer coordinates than the threshold
FAMILY = 4096             # sets that meet in lists are compared together up to so many, else list by list
BLOCK = 512
WIDTH, PERCENT = 5, 80
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
FACTORS = (np.random.default_rng(11).integers(0, 1 << 31, COORDINATES, np.uint32) * np.uint32(2) + np.uint32(1))
SHIFTS = np.random.default_rng(12).integers(0, 1 << 32, COORDINATES, np.uint32)


def threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest collision count that a pair of that similarity stays below with a chance of ``miss`` at most."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p ** k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


# sets and signatures

def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit names of the different shingles of the lower-cased (A-Z) words; a shorter text is one shingle, one without words none."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ h[k:k + n]) * MIX[0]
        out ^= out >> np.uint64(29)
    out *= MIX[1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(names: np.ndarray) -> np.ndarray:
    """The least value of each of the permutations over a set of shingle names."""
    x = ((names * MIX[2]) >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 4096):
        part = x[start:start + 4096]
        out = np.minimum(out, (FACTORS[:, None] * part[None, :] + SHIFTS[:, None]).min(axis=1))
    return out


def sign(docs: DataFrame, width: int, text: str, doc_id: str, row: str | None = None) -> DataFrame:
    """row, doc_id, text_key, n_shingles, digest of the set (null if empty), signature."""
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    picked = docs.select(number.alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
                         F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*picked.schema.fields[:3], T.StructField("n_shingles", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, digests, signs = [], [], []
                for body in batch.column("text").to_pylist():
                    names = shingle_set(body, width)
                    sizes.append(len(names))
                    digests.append(hashlib.blake2b(names.tobytes(), digest_size=16).digest() if len(names) else None)
                    signs.append(signature(names).view(np.int32) if len(names) else np.zeros(0, np.int32))
                flat = pa.array(np.concatenate(signs), pa.int32())
                offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in signs])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                                  pa.ListArray.from_arrays(offsets, flat)], schema=arrow)

    return picked.mapInArrow(run, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(rep, names) of the wanted rows (rep, doc_id, text_key): their texts are read again rather than all sets stored."""
    keyed = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    right = broadcast_measured(wanted.select(F.col("rep"), F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")))
    found = keyed.join(right, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                names = [shingle_set(body, width).tobytes() for body in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(names, pa.binary())], names=["rep", "names"])

    return durable(found.mapInArrow(run, "rep long, names binary").dropDuplicates(["rep"]))


# links

def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share enough: 100 x shared >= percent x all."""
    with_sets = (pairs.join(sets.withColumnsRenamed({"rep": "a", "names": "x"}), "a")
                 .join(sets.withColumnsRenamed({"rep": "b", "names": "y"}), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return with_sets.mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many names each two of the sets share, through a product of 0/1 columns of the names that occur twice."""
    m = len(sets)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice = count > 1
    renumbered = np.cumsum(twice) - 1
    keep = twice[column]
    column, owner = renumbered[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((m, m), np.float32)
    width = max(256, (4 << 20) // max(1, m))
    for start in range(0, int(twice.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def block_links(part: pa.Table, percent: int) -> pa.Table:
    """Links between the blocks of a task, between different components only and no more than join them."""
    part = part.combine_chunks()
    left, right = part.column("i")[0].as_py(), part.column("j")[0].as_py()
    reps, labels, blocks = (np.asarray(part.column(c)) for c in ("rep", "label", "block"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("names")]
    shared, n = shared_counts(sets), np.array([len(s) for s in sets])
    good = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    good &= labels[:, None] != labels[None, :]
    if left != right:
        good &= blocks[:, None] != blocks[None, :]
    parent = {x: x for x in labels.tolist()}

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    for x, y in zip(*np.nonzero(np.triu(good, 1))):
        p, q = top(int(labels[x])), top(int(labels[y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            a.append(int(reps[x]))
            b.append(int(reps[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def remaining_links(lists: DataFrame, edges: DataFrame, sets: DataFrame, percent: int, family: int = FAMILY, block: int = BLOCK) -> DataFrame | None:
    """Links within posting lists that hold several components after the merge with their most central sets."""
    labels = components(edges).select(F.col("id").alias("rep"), "component")
    rest = (lists.where("rep <> lead").join(labels, "rep", "left")
            .select("key", "rep", F.coalesce("component", "rep").alias("label")))
    open_keys = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = durable(rest.join(open_keys, "key"))
    if rest.isEmpty():
        return None
    stars = rest.join(rest.groupBy("key").agg(F.min("rep").alias("first")), "key").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    families = components(stars).withColumnsRenamed({"id": "rep", "component": "family"})
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))
    placed = rest.join(families, "rep").join(sizes, "family")
    whole = F.col("size") <= family
    groups = placed.select(F.when(whole, F.col("family")).otherwise(F.col("key")).alias("g"), whole.alias("whole"), "rep", "label").distinct()
    counts = groups.groupBy("g", "whole").agg(F.count("*").alias("n"))
    dealt = (groups.join(counts, ["g", "whole"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("g", "whole", "rep", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    dealt = dealt.join(sets, "rep")
    return dealt.groupBy("g", "whole", "i", "j").applyInArrow(lambda part: block_links(part, percent), "a long, b long")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id",
                row: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id (smallest doc_id of the group) and first (the one row of the group that stays).

    Two texts are linked where their shingle sets share ``percent`` of what
    they have together. Equal sets are one class from the start, so copies
    never meet each other. Texts without words, null ones too, are linked with
    nothing. Null ids are the greatest of a group; repeated rows are copies,
    of which one is ``first``. An empty table gives an empty result. Further
    columns of ``docs`` are not read.
    """
    need = threshold(percent)
    signed = durable(sign(docs, width, text, doc_id, row))
    classes = durable(signed.where("digest is not null").groupBy("digest")
                      .agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row", "text_key", "signature")).alias("r"))
                      .select("digest", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("doc_id"), F.col("r.text_key").alias("text_key"), F.col("r.signature").alias("signature")))
    posted = classes.select("rep", F.posexplode("signature").alias("at", "value")).select("rep", F.xxhash64("at", "value").alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    by_rep = (posted.join(often, "key").groupBy("rep")
              .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("pairs"), F.sum("df").alias("central")))
    # pairs that a set has alone come first in the order by frequency, and fill that much of its prefix
    left_of_prefix = F.size("pairs") - (need - 1)
    prefix = by_rep.where(left_of_prefix > 0).select("rep", "central", F.explode(F.slice("pairs", 1, F.greatest(left_of_prefix, F.lit(1)))).alias("p"))
    prefix = durable(prefix.select(F.col("p.key").alias("key"), "rep", "central"))
    leads = prefix.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("m")).where("n > 1")
    lists = durable(prefix.join(leads.select("key", (-F.col("m.minus")).alias("lead")), "key").select("key", "rep", "lead"))
    pairs = lists.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    marks = classes.select("rep", "signature")
    collide = F.size(F.filter(F.arrays_zip("x", "y"), lambda z: z["x"] == z["y"]))
    pairs = (pairs.join(marks.withColumnsRenamed({"rep": "a", "signature": "x"}), "a").join(marks.withColumnsRenamed({"rep": "b", "signature": "y"}), "b")
             .where(collide >= need).select("a", "b"))
    active = lists.select("rep").union(lists.select("lead")).distinct()
    sets = sets_of(docs, classes.join(active, "rep").select("rep", "doc_id", "text_key"), width, text, doc_id)
    edges = durable(linked(durable(pairs), sets, percent))
    more = remaining_links(lists, edges, sets, percent)
    edges = edges if more is None else durable(edges.union(more))
    found = components(edges).withColumnRenamed("id", "rep")
    named = classes.select("digest", "rep", "doc_id").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    firsts = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("id"), F.col("rep").alias("row"))).alias("first"))
    by_digest = durable(named.join(firsts, "component").select("digest", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row")))
    return (signed.join(by_digest, "digest", "left")
            .select("row", "doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    (F.col("digest").isNull() | (F.col("row") == F.col("first_row"))).alias("first")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those of a group except its first, with their columns."""
    number = fresh(docs, "place_in_scan")
    numbered = stored_texts(docs.withColumn(number, F.monotonically_increasing_id()))
    dropped = near_groups(numbered, row=number, **options).where("not first").select(F.col("row").alias(number))
    return numbered.join(broadcast_measured(dropped), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(table(spark, folder, "documents"), width=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
