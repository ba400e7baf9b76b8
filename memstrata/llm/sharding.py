"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by
a seeded hash. Pass two puts each bucket into one random order by a
Fisher-Yates shuffle and writes it. The buckets one after another are the
shuffled corpus; shards are equal runs of it, so their row counts differ by
one at most (the law ``rows``).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memstrata.session import broadcast_measured, durable, prefix_sums, shared_folder

from .common import fresh, table

BUCKET_BYTES = 24 << 20
SHARDS = 24
SEED = 20240


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: the element at each place is swapped with one at or before it."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else order
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", seed: int = SEED,
                   bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write the records in shuffled order, and read them back with ``shard`` and ``slot``.

    Whole records are moved, whatever their columns; ``shard`` and ``slot``
    are added (with underscores in front while the frame has such a column
    already). ``shard`` runs from 0 to ``shards`` - 1, ``slot`` from 0 without
    gaps in each shard. Null and equal texts, null ids and repeated rows are
    records like any other: the hash of the scatter takes the place of the
    row in the scan, so that even a row repeated endlessly is spread. An
    empty table gives an empty result; with fewer rows than shards, some
    shards are empty.

    The scan is numbered, so a record's bucket is the same when a lost task
    runs again as long as its input keeps its order: pass a frame that reads
    files. Each bucket is sorted by that number before it is shuffled, so a
    rerun of a bucket gives the same order.
    """
    spark = docs.sparkSession
    row, bucket, place = (fresh(docs, x) for x in ("place_in_scan", "bucket", "place_in_bucket"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 256)).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))
    key = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{row}`")), F.lit(buckets)).cast("int")
    names = [*docs.columns, row]
    out_schema = T.StructType([*docs.schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField(place, T.LongType())])

    def shuffled(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        number = part.column(bucket)[0].as_py()
        part = part.take(pc.sort_indices(part, sort_keys=[(row, "ascending")]))
        order = fisher_yates(part.num_rows, np.random.default_rng([seed, number]))
        part = part.take(pa.array(order)).drop_columns([row])
        return (part.drop_columns([bucket]).append_column(bucket, part.column(bucket))
                .append_column(place, pa.array(np.arange(part.num_rows), pa.int64())))

    scattered = numbered.withColumn(bucket, key).select(*[f"`{c}`" for c in names], F.col(f"`{bucket}`"))
    mixed = scattered.groupBy(bucket).applyInArrow(shuffled, out_schema)
    path = path or f"{shared_folder(spark).rstrip('/')}/memstrata/{spark.sparkContext.applicationId}/shuffled-{uuid.uuid4().hex}"
    mixed.write.option("compression", "zstd").parquet(path)
    mixed = spark.read.schema(mixed.schema).parquet(path)
    # the start of each bucket in the whole order, from the written rows
    counts = durable(mixed.groupBy(F.col(f"`{bucket}`").alias("of")).agg(F.count("*").alias("n")))
    total_rows = counts.agg(F.sum("n")).first()[0] or 0
    start, of = fresh(docs, "start_of_bucket"), fresh(docs, "number_of_bucket")
    starts = prefix_sums(counts, [], F.floor(F.col("of") / 1024), [F.col("of")], F.col("n"), "start")
    starts = starts.select(F.col("of").alias(of), F.col("start").alias(start))
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    at = F.col(f"`{start}`") + F.col(f"`{place}`")
    return (mixed.join(broadcast_measured(starts), F.col(f"`{bucket}`") == F.col(f"`{of}`"))
            .withColumn(shard, F.expr(f"cast(({shards} * (`{start}` + `{place}` + 1) - 1) div {max(total_rows, 1)} as int)"))
            .withColumn(slot, at - F.expr(f"cast(`{shard}` as bigint) * {total_rows} div {shards}"))
            .select(*[F.col(f"`{c}`") for c in docs.columns], F.col(shard), F.col(slot)))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = shuffle_shards(table(spark, folder, "documents"))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))
