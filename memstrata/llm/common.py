"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memstrata.session import durable, shared_folder

SPACES = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text: runs without blank, tab, line feed, VT, FF and CR; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long"), F.lit(0).cast("long"))


def hex_unit(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of a text key."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold about ``limit`` bytes; a longer text is a part alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffers(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column."""
    texts = batch.column(column).cast(pa.large_binary())
    texts = pa.array(texts.fill_null(b""), pa.large_binary()) if texts.null_count else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored_texts(df: DataFrame) -> DataFrame:
    """Like ``durable``, for frames that carry whole texts: packed more closely."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/memstrata/{spark.sparkContext.applicationId}/texts-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (id, component), the component being its smallest id.

    Alternating star contraction: every id points at the smallest id it
    sees, first among larger neighbours, then among smaller ones. The number
    of rounds grows with the logarithm of the size, each is two groupings by
    id with combining minima, and the result of a round is a written table.
    Ids without an edge do not occur in the result.
    """
    edges = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # each id's larger neighbours move to its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # each id and its smaller neighbours move to the smallest of them
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = durable(large.join(root, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                                     F.col("m").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return (edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
            .union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
