"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed, a run of ``MIN_MATCH``
tokens (all tokens of a shorter item), are tiled: the longest match of unmarked tokens is marked again and
again, until none of ``MIN_MATCH`` tokens is left. Tiles do not overlap and
may lie in any order, so moved passages count. A document is contaminated
where tiles cover the given share of an item's tokens.

Seeds are found by running Karp-Rabin hashes over the token numbers of the
items; equal hashes are confirmed on the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_TOKENS = 1_000_000      # tokens of benchmark items that go to the tasks at once
ODD = np.uint64(0x9E3779B97F4A7C15)
STRIP = b".,;:!?\"'()[]{}<>*#|"


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words without surrounding punctuation; marks alone are no tokens."""
    return [w for w in (x.strip(STRIP) for x in text.encode().lower().split()) if w]


def rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` numbers."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= ODD
        out += numbers[k:k + n].astype(np.uint64)
    return out


def tile(text_at: np.ndarray, item_at: np.ndarray, width: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, item position, length) from the places of equal seeds.

    On a diagonal, consecutive seeds are one match. The longest match is
    marked, the first in the item and then in the text among equals; seeds
    that touch marked tokens go, and the rest is matched anew.
    """
    tiles = []
    order = np.lexsort((text_at, text_at - item_at))
    t, i = text_at[order], item_at[order]
    while len(t):
        starts = np.flatnonzero(np.r_[True, (t[1:] - i[1:] != t[:-1] - i[:-1]) | (t[1:] != t[:-1] + 1)])
        lengths = np.diff(np.r_[starts, len(t)]) + width - 1
        best = np.lexsort((t[starts], i[starts], -lengths))[0]
        a, b, n = int(t[starts[best]]), int(i[starts[best]]), int(lengths[best])
        tiles.append((a, b, n))
        free = ((t + width <= a) | (t >= a + n)) & ((i + width <= b) | (i >= b + n))
        t, i = t[free], i[free]
    return tiles


class Items:
    """A block of benchmark items as token numbers with their seeds."""

    def __init__(self, rows: list[tuple[object, str | None]], width: int = MIN_MATCH) -> None:
        self.ids, self.numbers = [i for i, _ in rows], {}
        self.lengths, self.tokens, self.widths = [], [], []
        by_width: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k, (_, text) in enumerate(rows):
            found = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in tokens_of(text or "")], np.int64)
            own = min(width, len(found))
            self.lengths.append(len(found))
            self.tokens.append(found)
            self.widths.append(own)
            if own:
                h = rolling(found, own)
                by_width.setdefault(own, []).append((h, np.full(len(h), k, np.int64), np.arange(len(h), dtype=np.int64)))
        #: By width of the seed: its hashes in order, the items and the places in them.
        self.seeds = {}
        for own, parts in by_width.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.seeds[own] = hashes[order], item[order], place[order]

    def found(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text positions, items, item positions) of equal seeds, for each width."""
        for width, (hashes, items, places) in self.seeds.items():
            if len(numbers) < width:
                continue
            at = np.flatnonzero(np.convolve(numbers != 0, np.ones(width, int), "valid") == width)
            if not len(at):
                continue
            h = rolling(numbers, width)[at]
            first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = last > first
            if not hit.any():
                continue
            at, first, count = at[hit], first[hit], (last - first)[hit]
            which = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            yield np.repeat(at, count), items[which], places[which]

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(item number, tiles) of the items that are covered enough. An item too short for a seed is a seed itself, and matches where it stands whole."""
        find = self.numbers.get
        numbers = np.array([find(w, 0) for w in tokens_of(text or "")], np.int64)
        parts = list(self.found(numbers))
        if not parts:
            return []
        text_at, item, item_at = (np.concatenate(x) for x in zip(*parts))
        out = []
        for k in np.unique(item):
            mine, width = item == k, self.widths[k]
            t, i = text_at[mine], item_at[mine]
            bound = np.zeros(self.lengths[k] + 1, int)
            np.add.at(bound, i, 1)
            np.add.at(bound, np.minimum(i + width, self.lengths[k]), -1)
            if (np.cumsum(bound)[:-1] > 0).sum() < coverage * self.lengths[k]:
                continue            # no tiling covers more than the seeds do
            same = np.ones(len(t), bool)
            for step in range(width):
                same &= numbers[t + step] == self.tokens[k][i + step]
            tiles = tile(t[same], i[same], width)
            if sum(n for *_, n in tiles) >= coverage * self.lengths[k]:
                out.append((int(k), tiles))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_tokens: int = BLOCK_TOKENS) -> Iterator[Items]:
    """The benchmark, the stated query set of the search, in blocks of bounded size."""
    held, size = [], 0
    for row in benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len((row["t"] or "").split())
        if size >= block_tokens:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


TILE = T.StructType([T.StructField("text_at", T.IntegerType()), T.StructField("item_at", T.IntegerType()), T.StructField("length", T.IntegerType())])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of each row of ``docs`` and each item that its tiles cover enough.

    Whole texts are compared with every item; a benchmark beyond
    ``BLOCK_TOKENS`` takes one scan for each block. An item of fewer
    than ``MIN_MATCH`` tokens matches where it stands whole, as one tile. Null
    and empty texts on either side match nothing; null ids are returned as
    null; repeated rows give repeated results; an empty table on either side
    gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([picked.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_id].dataType),
                           T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(TILE))])
    found = None
    for items in item_blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema
            arrow = to_arrow_schema(schema)
            items = sent.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    rows = []
                    for number, body in enumerate(batch.column("text").to_pylist()):
                        for k, tiles in items.matches(body, coverage):
                            rows.append((number, items.ids[k], sum(n for *_, n in tiles) / items.lengths[k],
                                         [{"text_at": a, "item_at": b, "length": n} for a, b, n in tiles]))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array([r[0] for r in rows])),
                             *[pa.array([r[c] for r in rows], arrow.field(c).type) for c in (1, 2, 3)]], schema=arrow)

        part = picked.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that no item of the benchmark is covered by; judged row by row, without a join."""
    spark, schema = docs.sparkSession, docs.schema
    for items in item_blocks(benchmark, item_id, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text):
                    clean = [not sent.value.matches(body, coverage) for body in batch.column(text).to_pylist()]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = find_contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"))
