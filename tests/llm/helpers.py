"""Frames with every awkward row, and plain forms of what the operators compute."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"
ROWS = [
    (1, PLAIN, "en", "a"), (2, PLAIN, "en", "b"), (2, PLAIN, "en", "b"), (2, PLAIN, "en", "b"), (None, PLAIN, None, None),
    (None, None, None, None), (3, None, "en", "a"), (4, "", "en", "a"), (5, "   \n\t ", "de", "c"), (6, LONG, "en", "a"),
    (7, "one", "en", "a"), (8, "ONE", "en", None), (9, "é ü ß 😀", "fr", "ß"), (10, PLAIN + " extra", None, "b"), (7, "two words", "en", "zz"),
]
BASE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
#: Names that operators add themselves.
CLASHING = ("size", "target", "source_size", "copies", "shard", "slot", "row", "bucket", "key", "component_id", "kept", "n", "Size", "place_in_scan", "text_key", "spans",
            "__u", "__like", "__times", "__copy", "copy", "__of", "__total", "__cut", "__goal", "__open", "given", "words", "liked",
            "__words", "__e", "__g0", "__length", "rows_all", "start_here", "start_of_bucket", "of", "g")


def awkward(spark: SparkSession, clash: bool = True):
    if not clash:
        return spark.createDataFrame(ROWS, BASE)
    names = [c for c in CLASHING if c != "Size"]
    schema = T.StructType([*BASE.fields, *[T.StructField(c, T.StringType()) for c in names]])
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in ROWS], schema)


def empty(spark: SparkSession):
    return spark.createDataFrame([], BASE)


def documents(spark: SparkSession, folder: str = FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def shingles(text: str | None, width: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, int]:
    """The smallest id that each id reaches, by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}
