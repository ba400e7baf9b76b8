"""Session conventions and durable intermediate tables.

Intermediate results that are read several times, or that would otherwise
carry a long lineage, are written as Parquet into the folder shared by all
executors. A lost executor then costs a re-read and nothing is recomputed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import usd_add

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def utc_session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="memstrata-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """Named durable tables of one application."""

    _open: dict[tuple[str, str], "Workspace"] = {}

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = utc_session(spark)
        app = spark.sparkContext.applicationId
        self.root = f"{shared_folder(spark).rstrip('/')}/memstrata/{app}/{name}-{uuid.uuid4().hex[:8]}"
        self._ready: dict[str, str] = {}

    @classmethod
    def of(cls, spark: SparkSession, name: str) -> "Workspace":
        key = (spark.sparkContext.applicationId, name)
        if key not in cls._open:
            cls._open[key] = cls(spark, name)
        return cls._open[key]

    def holds(self, name: str) -> bool:
        return name in self._ready

    def table(self, name: str, build: Callable[[], DataFrame],
              partition_by: list[str] | None = None) -> DataFrame:
        """Write the frame once, afterwards read the written table."""
        if name not in self._ready:
            path = f"{self.root}/{name}"
            writer = build().write.mode("overwrite").option("compression", "zstd")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            self._ready[name] = path
        return self.spark.read.parquet(self._ready[name])


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a written table in the shared folder."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/memstrata/{app}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, rows_a_file: int = 20_000) -> DataFrame:
    """``durable`` in equal files, several for each core at least: for rows that cost far more work than bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return durable(df.repartition(max(4 * cores, -(-rows // rows_a_file))))


def broadcast_measured(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Write the frame, measure its real volume, hint a broadcast if it fits.

    Plain small tables are left to the optimizer, which knows their file size.
    This is for frames whose volume it cannot bound, such as exploded terms,
    joined with a side too large to shuffle. Beyond the limit the frame stays
    unhinted: the join is shuffled and adaptive execution splits skew.
    """
    written = durable(df)
    volume = written.agg(F.sum(F.octet_length(F.to_json(F.struct(*written.columns))))).first()[0] or 0
    return F.broadcast(written) if volume <= limit else written


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row, without a join."""
    both = rows[0]
    for row in rows[1:]:
        both = both.unionByName(row, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def dense_position(df: DataFrame, order: list[str], buckets: list[Column], name: str) -> DataFrame:
    """A global 1-based row number without a single-task window.

    ``buckets`` must be leading parts of the sort order, from coarse to fine,
    so that sorting by bucket and then by ``order`` is the whole order. Rows are
    numbered inside their bucket. Offsets have two levels: of the coarse
    buckets, which are few (days), and of the fine ones inside each.
    """
    from pyspark.sql import Window
    keys = [f"__b{i}" for i in range(len(buckets))]
    tagged = df.select("*", *[b.alias(k) for b, k in zip(buckets, keys)])
    counts = tagged.groupBy(*keys).agg(F.count("*").alias("__n"))
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = counts.groupBy(keys[0]).agg(F.sum("__n").alias("__n"))
    offsets = coarse.select(keys[0], earlier(Window.orderBy(keys[0])).alias("__offset"))
    if len(keys) > 1:
        fine = counts.select(*keys, earlier(Window.partitionBy(keys[0]).orderBy(*keys[1:])).alias("__inside"))
        offsets = fine.join(offsets, keys[0]).select(*keys, (F.col("__offset") + F.col("__inside")).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (tagged.withColumn("__r", F.row_number().over(inside))
            .join(offsets, keys)
            .withColumn(name, (F.col("__offset") + F.col("__r")).cast("long"))
            .drop(*keys, "__r", "__offset"))


def prefix_sums(df: DataFrame, keys: list[str], slot: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the same key, the row excluded.

    The key is split by ``slot``, a leading part of the order, so a key that
    holds a third of all rows is still summed by many tasks.
    """
    from pyspark.sql import Window
    tagged = df.withColumn("__slot", slot).withColumn("__v", value)
    totals = tagged.groupBy(*keys, "__slot").agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, "__slot", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*keys, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__v").over(inside), F.lit(0))
    money = dict(tagged.dtypes)["__v"].startswith("decimal")
    total = usd_add(F.col("__shift"), F.col("__before")) if money else F.col("__shift") + F.col("__before")
    return (tagged.withColumn("__before", before).join(shifts, [*keys, "__slot"])
            .withColumn(name, total)
            .drop("__slot", "__v", "__before", "__shift"))


def numbered(df: DataFrame, keys: list[str], slot: Column, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position inside each key, for keys of any size; ``slot`` leads the order."""
    out = prefix_sums(df, keys, slot, order, F.lit(1).cast("long"), name)
    return out.withColumn(name, F.col(name) + 1)


def ordered_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows cut into runs of the whole order, ``__range`` numbering the runs.

    Spark samples the order for the cuts, so equal volumes come together
    whatever the values are; written, because the cuts must stay.
    """
    return durable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def running_ranges(df: DataFrame, order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges) for a running sum of money over a whole table, without a key.

    ``rows`` carry ``__inside``, the sum over earlier rows of their own range,
    the row excluded. ``ranges`` hold one row per range, as many as shuffle
    partitions: ``__shift``, the sum over all earlier ranges, and ``__peak``,
    the largest sum reached after a row of the range, counted from its start.
    The sum before a row is ``__shift + __inside``; a range whose
    ``__shift + __peak`` stays below a limit passes it nowhere. The order must
    tell all rows apart; null amounts count nothing.
    """
    from pyspark.sql import Window
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    amount = F.coalesce(F.col(value), F.lit(0).cast("decimal(38,12)"))
    rows = durable(ordered_ranges(df, order).withColumn(
        "__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0).cast("decimal(38,12)"))))
    totals = rows.groupBy("__range").agg(F.sum(amount).alias("__sum"), F.max(usd_add(F.col("__inside"), amount)).alias("__peak"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.select("__range", "__peak", F.coalesce(F.sum("__sum").over(earlier), F.lit(0).cast("decimal(38,12)")).alias("__shift"))
    return rows, durable(ranges)
