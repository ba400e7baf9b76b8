"""Full-text scores of a set of queries over shards of the index.

A shard is one stored row: neighbouring memories, and for each term the
memories that hold it and how often. All terms of a memory are in its shard,
so a task has whole scores before anything is shuffled: a search sends k rows
per query and shard, and a list of all hits is not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import broadcast_measured, durable

SHARD = 4096               # sequence numbers, or memories, of a shard
BLOCK_ROWS = 400_000       # (query, term) rows that go to the tasks at once
OUT_ROWS = 100_000         # rows of a batch of results
SHARD_SCHEMA = "shard long, memories array<string>, seqs binary, depths binary, lengths binary, terms array<string>, dfs array<long>, starts binary, docs binary, tfs binary, n_docs long, n_tokens long"
SHARD_ARROW = pa.schema([(name, {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}[kind])
                         for name, kind in (column.split() for column in SHARD_SCHEMA.split(", "))])
PART_BYTES = 32 * 1024 * 1024   # of the texts that one task tokenises


def _shard(rows: pa.Table) -> pa.Table:
    """One stored row of the memories of a shard; a memory is told by its id, seq and depth."""
    rows = rows.filter(pc.greater(pc.list_value_length(rows.column("tokens")), 0)).combine_chunks()
    if not rows.num_rows:
        return SHARD_ARROW.empty_table()
    ids = rows.column("memory_id").combine_chunks().dictionary_encode()
    code, seq, depth = ids.indices.to_numpy(), rows.column("seq").to_numpy(), rows.column("depth").to_numpy()
    by_doc = np.lexsort((depth, code, seq))
    new = np.r_[True, (np.diff(seq[by_doc]) != 0) | (np.diff(code[by_doc]) != 0) | (np.diff(depth[by_doc]) != 0)]
    doc = np.empty(len(seq), np.int64)
    doc[by_doc] = np.cumsum(new) - 1
    first = by_doc[new]
    tokens = rows.column("tokens").combine_chunks()
    terms = pc.list_flatten(tokens).dictionary_encode()
    size = pc.list_value_length(tokens).to_numpy()
    # one number per (term, memory), ascending: the postings in stored order
    pairs, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(first) + np.repeat(doc, size), return_counts=True)
    term, held = np.divmod(pairs, len(first))
    starts = np.searchsorted(term, np.arange(len(terms.dictionary) + 1))
    blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    return pa.table({
        "shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "memories": pa.array([ids.dictionary.take(pa.array(code[first])).to_pylist()], pa.list_(pa.string())),
        "seqs": blob(seq[first], np.int64), "depths": blob(depth[first], np.int32), "lengths": blob(size[first], np.int32),
        "terms": pa.array([terms.dictionary.to_pylist()], pa.list_(pa.string())), "dfs": pa.array([np.diff(starts)], pa.list_(pa.int64())),
        "starts": blob(starts, np.int64), "docs": blob(held, np.int32), "tfs": blob(tf, np.int32),
        "n_docs": pa.array([len(first)], pa.int64()), "n_tokens": pa.array([int(size[first].sum())], pa.int64())})


def build_shards(memories: DataFrame, size: int = SHARD) -> DataFrame:
    """The shards of an index over id and content; the texts of ``size`` sequence numbers meet in one task.

    Texts are shuffled and sorted, tokens are not: those are several times as
    large. By the volume of the texts, and one part per reducer at least.
    """
    tokens = F.concat(S.index_tokens(F.col("memory_id")), S.index_tokens(F.col("content")))
    rows = memories.select(F.floor(F.col("seq") / size).cast("long").alias("shard"), F.col("id").alias("memory_id"), "seq", "depth", "content")
    volume = memories.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = max(int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-volume // PART_BYTES))
    met = rows.repartition(parts, "shard").sortWithinPartitions("shard")
    return met.select("shard", "memory_id", "seq", "depth", tokens.alias("tokens")).groupBy("shard").applyInArrow(_shard, SHARD_SCHEMA)


def shards_in_place(memories: DataFrame, size: int = SHARD) -> DataFrame:
    """The shards of memories that are one row each, cut where the rows are read: no text is shuffled.

    ``size`` rows of a task make a shard, so its memories need not be
    neighbours and its number is its smallest sequence number.
    """
    tokens = F.concat(S.index_tokens(F.col("id")), S.index_tokens(F.col("content")))
    rows = memories.select(F.col("id").alias("memory_id"), F.col("seq").cast("long").alias("seq"), F.col("depth").cast("int").alias("depth"), tokens.alias("tokens"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> list[pa.RecordBatch]:
            return _shard(table.append_column("shard", pa.array([pc.min(table.column("seq")).as_py()] * table.num_rows, pa.int64()))).to_batches()

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while n + batch.num_rows >= size:
                yield from made(pa.Table.from_batches([*held, batch.slice(0, size - n)]))
                batch, held, n = batch.slice(size - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield from made(pa.Table.from_batches(held))

    return rows.mapInArrow(cut, SHARD_SCHEMA)


def shard_collection(shards: DataFrame) -> DataFrame:
    """One row: documents and mean length, from the counts that the shards keep."""
    return shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("n_tokens") / F.sum("n_docs")).alias("avg_len"))


def shard_frequencies(shards: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, df): in how many memories a term occurs, of the terms of ``wanted(term)`` alone if given."""
    counts = shards.select(F.inline(F.arrays_zip("terms", "dfs"))).withColumnRenamed("terms", "term")
    if wanted is not None:
        counts = counts.join(broadcast_measured(wanted.select("term").distinct()), "term")
    return counts.groupBy("term").agg(F.sum("dfs").alias("df")).sortWithinPartitions("term")


def shard_postings(shards: DataFrame) -> DataFrame:
    """(term, memory_id, seq, depth, doc_len, tf) of the stored shards."""
    schema = "term string, memory_id string, seq long, depth int, doc_len int, tf long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch.slice(n, 1).to_pylist()[0], lambda lengths: lengths)
                term = np.repeat(np.arange(len(shard.terms)), np.diff(shard.starts))
                for at in range(0, len(term), OUT_ROWS):
                    here = slice(at, at + OUT_ROWS)
                    doc = shard.docs[here]
                    yield pa.RecordBatch.from_arrays(
                        [shard.terms.take(pa.array(term[here])), shard.memories.take(pa.array(doc)), pa.array(shard.seqs[doc]), pa.array(shard.depths[doc]),
                         pa.array(shard.norm[doc].astype(np.int32)), pa.array(shard.tfs[here].astype(np.int64))],
                        names=["term", "memory_id", "seq", "depth", "doc_len", "tf"])

    return shards.mapInArrow(rows, schema)


class Shard:
    """A stored shard, ready to be scored."""

    def __init__(self, row: dict, norm) -> None:
        kinds = {"seqs": np.int64, "depths": np.int32, "starts": np.int64, "docs": np.int32, "tfs": np.int32}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.memories, self.terms = pa.array(row["memories"], pa.string()), pa.array(row["terms"], pa.string())
        self.names = np.array(row["memories"], object)
        self.norm = norm(np.frombuffer(row["lengths"], np.int32).astype(np.float64))

    def search(self, terms: np.ndarray, weights: np.ndarray, shown: np.ndarray, k: int | None, k1: float) -> tuple[np.ndarray, np.ndarray]:
        """(memories, scores) of all shown hits, or of the best ``k`` by score and then id."""
        begin, n = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        docs, tf = self.docs[at], self.tfs[at].astype(np.float64)
        part = (np.repeat(weights, n) * (tf * (k1 + 1))) / (tf + self.norm[docs])
        # sums are ranked on a stable number
        scores = np.round(np.bincount(docs, part, len(self.names)), 9)
        held = np.zeros(len(self.names), bool)
        held[docs] = True
        hit = np.flatnonzero(held & shown)
        if k is None:
            return hit, scores[hit]
        if len(hit) > k:
            hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k]]
        best = np.array(sorted(hit.tolist(), key=lambda d: (-scores[d], self.names[d]))[:k], np.int64)
        return best, scores[best]


def score_shards(weighted: DataFrame, shards: DataFrame, avg_len: float, k1: float, b: float, k: int | None = None, *,
                 depth: int | None = None, high_water: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, memory_id, seq, depth, score) of ``weighted(query_id, term, weight)``: all hits, or the best ``k`` of each shard.

    The queries are the stated set of the search. They go to the tasks in
    blocks of a bounded number of terms, one after the other, and the shards
    are scanned in place for each. ``depth`` and ``high_water`` hide memories
    before the limit.
    """
    spark, kind = shards.sparkSession, weighted.schema["query_id"].dataType
    schema = f"query_id {kind.simpleString()}, memory_id string, seq long, depth int, score double"
    total = durable(weighted.select("query_id", "term", "weight", F.xxhash64("query_id").alias("group")))
    blocks = max(1, -(-total.count() // block_rows))
    found = None
    for number in range(blocks):
        rows = total.where(F.pmod("group", F.lit(blocks)) == number).toPandas()
        if not len(rows):
            continue
        of, queries = pd.factorize(rows["query_id"], use_na_sentinel=False)
        rows, of = rows.iloc[np.argsort(of, kind="stable")], np.sort(of, kind="stable")
        codes, names = rows["term"].factorize()
        held = spark.sparkContext.broadcast((queries.tolist(), np.searchsorted(of, np.arange(len(queries) + 1)), codes, list(names), rows["weight"].to_numpy(np.float64)))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type
            queries, edges, codes, names, weights = held.value
            wanted, ids = pa.array(names, pa.string()), pa.array([None if pd.isna(q) else q for q in queries], to_arrow_type(kind))
            norm = lambda lengths: k1 * (1 - b + b * lengths / avg_len)

            def batch_of(shard: Shard, out: list) -> pa.RecordBatch:
                doc = np.concatenate([d for _, d, _ in out])
                query = np.repeat([q for q, _, _ in out], [len(d) for _, d, _ in out])
                score = np.concatenate([s for _, _, s in out])
                if k is None:
                    # all hits of a memory stand together, so a table of them repeats its id in one place
                    order = np.argsort(doc, kind="stable")
                    doc, query, score = doc[order], query[order], score[order]
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(query)), shard.memories.take(pa.array(doc)), pa.array(shard.seqs[doc]), pa.array(shard.depths[doc]),
                     pa.array(score)], names=["query_id", "memory_id", "seq", "depth", "score"])

            for batch in batches:
                for n in range(batch.num_rows):
                    shard = Shard(batch.slice(n, 1).to_pylist()[0], norm)
                    shown = np.ones(len(shard.seqs), bool)
                    if depth is not None:
                        shown &= shard.depths == depth
                    if high_water is not None:
                        shown &= shard.seqs <= high_water
                    if not shown.any():
                        continue
                    local = pc.index_in(wanted, shard.terms).fill_null(-1).to_numpy(zero_copy_only=False)[codes]
                    out, size = [], 0
                    for q in range(len(queries)):
                        part = slice(edges[q], edges[q + 1])
                        here = local[part] >= 0
                        if here.any():
                            doc, score = shard.search(local[part][here], weights[part][here], shown, k, k1)
                            if len(doc):
                                out.append((q, doc, score))
                                size += len(doc)
                        if size >= OUT_ROWS:
                            yield batch_of(shard, out)
                            out, size = [], 0
                    if out:
                        yield batch_of(shard, out)

        part = shards.mapInArrow(search, schema)
        # one block of queries is with the tasks at a time
        part = part if blocks == 1 else durable(part)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
