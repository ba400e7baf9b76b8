"""Reading and writing the ledger tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JSON_COLUMNS, schema

REPORT_TABLES = ("sources", "memories", "derived_from", "runs", "run_work", "api_calls",
                 "activity_operations", "activity_relation_results", "activity_api_calls", "state")


def parse_json_columns(df: DataFrame) -> DataFrame:
    """Every ``*_json`` column becomes a typed column without the suffix; bad JSON is null."""
    out = df
    for column, shape in JSON_COLUMNS.items():
        if column in df.columns:
            out = out.withColumn(column.removesuffix("_json"), F.from_json(column, shape)).drop(column)
    return out


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stored table with its declared schema, empty when it is not there."""
    try:
        return spark.read.schema(schema(name)).parquet(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema(name))


def scan_ledger(spark: SparkSession, folder: str, tables: tuple[str, ...] = REPORT_TABLES) -> dict[str, DataFrame]:
    """Declared-schema frames of a stored corpus; an absent table is an empty one."""
    return {name: parse_json_columns(read_table(spark, folder, name)) for name in tables}


def late_content(ids: DataFrame, memories: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Content of the referenced memories only, fetched after the id set is known.

    ``memories`` is a table, or a function that gives (id, content) of the
    memories of ``wanted(id)``, where contents can be chosen before they travel.
    """
    wanted = ids.select(F.col("memory_id").alias("id")).distinct()
    if callable(memories):
        return memories(wanted)
    return memories.select("id", "content").join(wanted, "id", "left_semi")


def export_calls(api_calls: DataFrame, path: str) -> None:
    """All calls as JSON lines with explicit nulls, in insertion order."""
    (api_calls.orderBy("ordinal").write.mode("overwrite")
     .option("ignoreNullFields", False).json(path))


def write_metrics(metrics: DataFrame, key: str, path: str) -> None:
    metrics.orderBy(key).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_dates(report: DataFrame, path: str) -> None:
    """Replace exactly the dates contained in the frame, keep all others."""
    (report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))
