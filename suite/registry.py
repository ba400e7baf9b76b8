"""Query registry: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memstrata.sources.corpus import Corpus

from .bindings_sql import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain output types: money as rounded doubles, dates and id lists as text, integers as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = F.round(c.cast("double"), 9)
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(name))
    return df.select(*out)


def with_ctes(sql: str) -> str:
    """Prefix the statement with the bindings it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in re.findall(r"\bc_[a-z0-9_]+\b", text):
            if name in CTES and name not in order and name not in trail:
                visit(CTES[name][1], (*trail, name))
                if name not in order:
                    order.append(name)

    visit(sql, ())
    if not order:
        return sql
    parts = [f"{name}{CTES[name][0]} AS ({CTES[name][1]})" if not CTES[name][0].endswith("MATERIALIZED") else f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order]
    head = "WITH RECURSIVE " + ",\n".join(parts)
    if sql[:5].lower() == "with ":
        return head + ",\n" + sql[5:]
    return head + "\n" + sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(fn(Corpus.of(spark, folder)))
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql.strip())
        return fn
    return register


def usd(expr: str) -> str:
    return f"round(cast({expr} as double), 9)"
