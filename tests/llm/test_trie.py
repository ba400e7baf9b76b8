import collections
import hashlib
import zlib

from pyspark.sql import functions as F

from memstrata.llm import trie
from suite.check import compare, connect

from .helpers import FOLDER, LONG

TALK = [("system", "Be brief."), ("user", "Why?"), ("assistant", "So.")]
ROWS = [
    *[(c, t, *TALK[t]) for c in (0, 1, 2, 3, 105) for t in range(3)], *[(c, t, "user", f"{t}") for c in (100, 101, 102) for t in range(7)],
    *[(7, None, None, None)] * 3, (7, 2, "user", "é😀"), (7, 2, "assistant", "b"), (None, 1, "user", "lost"), (-3, 5, "user", LONG), (-250, 1, "x", ""), (-250, 0, None, "y"),
    *[(500 + c, t, "user", f"m{t % 3}") for c in range(30) for t in range(c % 4 + 1)], (901, 0, "user", "one"), (902, 0, "user", "one"),
]
NAMES = ["depth", "position", "content", "c", "d", "e", "slot", "x1", "n_convs"]


def table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], schema)


def plain(rows):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for c, held in talks.items():
        held.sort(key=lambda r: (*r[:2], r[2].encode(), hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()))
    built = {}
    for c, held in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        built[c] = [r[2:] for r in talks.get(base, [])[:h]] + [r[2:] for r in held[h:]]
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = {p for p in below if len(p) == len(path) + 1}
        childless = [p for p in below if not any(q[:len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(built[c]) == len(path)))
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(kids), len(childless), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    assert sorted([tuple(r) for r in trie.prefix_trie(table(spark, ROWS)).collect()], key=repr) == plain(ROWS)


def test_empty_table(spark):
    assert trie.prefix_trie(table(spark, ROWS).limit(0)).count() == 0


def test_windows_split_long_sequences(spark, monkeypatch):
    for name, size in (("SLOT", 2), ("SIBLING_BITS", 1), ("ENDS_BITS", 1), ("TOUR_SLOT", 5)):
        monkeypatch.setattr(trie, name, size)
    assert sorted([tuple(r) for r in trie.prefix_trie(table(spark, ROWS)).collect()], key=repr) == plain(ROWS)


def test_list_ranking(spark):
    n = 700
    order = spark.range(n).select((F.col("id") * 37 % n).alias("c"), ((F.col("id") + 1) * 37 % n).alias("nc"), "id")
    last = F.col("id") == n - 1
    arcs = order.select("c", F.lit(0).cast("long").alias("d"), F.lit(False).alias("e"), F.when(~last, F.col("nc")).alias("nc"),
                        F.when(~last, 0).cast("long").alias("nd"), F.when(~last, False).alias("ne"))
    for marked in (4, 1 << 30):
        assert {r.c: r.position for r in trie.rank(arcs, marked).collect()} == {i * 37 % n: i for i in range(n)}


def test_query(spark):
    assert compare(trie.op13(spark, FOLDER), connect(FOLDER), trie.OP13_SQL) is None
