"""Table rules as data-quality checks, and comparisons of corpora and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars as S
from ..schemas import STATUS_DOMAIN


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _bad(df: DataFrame, rule: str, condition: Column, key: Column) -> DataFrame:
    return df.filter(condition).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _repeated(df: DataFrame, rule: str, columns: list[str]) -> DataFrame:
    return (df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
            .select(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("key")))


def _dangling(df: DataFrame, rule: str, column: str, target: DataFrame) -> DataFrame:
    ids = target.select(F.col("id").alias(column))
    return (df.filter(F.col(column).isNotNull()).join(ids, column, "left_anti")
            .select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key")).distinct())


def graph_violations(memories: DataFrame, derived_from: DataFrame, roots: DataFrame, relations: DataFrame,
                     sources: DataFrame, config: EngineConfig) -> DataFrame:
    """(rule, key) of every broken corpus rule."""
    depth = F.col("depth")
    shape = (((depth == 0) & (F.col("source_ref").isNull() | (F.col("dream_revision") != 0)))
             | ((depth > 0) & (F.col("source_ref").isNotNull() | (F.col("dream_revision") <= 0))))
    child = memories.select(F.col("id").alias("child_id"), depth.alias("child_depth"))
    parent = memories.select(F.col("id").alias("parent_id"), depth.alias("parent_depth"))
    edges = derived_from.join(child, "child_id").join(parent, "parent_id")
    pair = F.concat_ws("|", "child_id", "parent_id")
    n_parents = derived_from.groupBy(F.col("child_id").alias("id")).agg(F.countDistinct("parent_id").alias("n_parents"))
    n_roots = roots.groupBy(F.col("memory_id").alias("id")).agg(F.countDistinct("source_id").alias("n_roots"))
    support = (memories.filter("depth > 0").join(n_parents, "id", "left").join(n_roots, "id", "left")
               .fillna(0, ["n_parents", "n_roots"]))
    return _union([
        _bad(memories, "negative depth", depth < 0, F.col("id")),
        _bad(memories, "depth and origin disagree", shape, F.col("id")),
        _bad(memories, "blank content", S.is_blank(F.col("content")), F.col("id")),
        _bad(edges, "parent is not one level below", F.col("parent_depth") != F.col("child_depth") - 1, pair),
        _bad(derived_from, "self edge", F.col("child_id") == F.col("parent_id"), pair),
        _bad(relations, "self relation", F.col("memory_id") == F.col("related_memory_id"), F.col("seq")),
        _bad(relations, "relation kind", ~F.col("kind").isin(*STATUS_DOMAIN["relation_kinds"]), F.col("seq")),
        _bad(sources, "source status", ~F.col("status").isin(*STATUS_DOMAIN["sources"]), F.col("id")),
        _bad(support, "fewer than B parents", F.col("n_parents") < config.root_base, F.col("id")),
        _bad(support, "fewer than B^depth roots", F.col("n_roots") < S.root_threshold(config.root_base, depth), F.col("id")),
        _repeated(memories, "duplicate memory id", ["id"]),
        _repeated(memories, "duplicate origin key", ["origin_key"]),
        _repeated(sources, "duplicate content hash", ["content_hash"]),
        _repeated(derived_from, "duplicate edge", ["child_id", "parent_id"]),
        _repeated(relations, "duplicate relation", ["memory_id", "related_memory_id", "kind"]),
        _dangling(derived_from, "unknown child", "child_id", memories),
        _dangling(derived_from, "unknown parent", "parent_id", memories),
        _dangling(memories, "unknown source", "source_ref", sources),
        _dangling(relations, "unknown relation owner", "memory_id", memories),
        _dangling(relations, "unknown relation target", "related_memory_id", memories),
    ])


def history_violations(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(rule, key): deleted rows, changed immutable columns, unsealed memories."""
    keys = {"memories": ["id"], "sources": ["id"], "derived_from": ["child_id", "parent_id"],
            "memory_roots": ["memory_id", "source_id"], "relations": ["memory_id", "related_memory_id", "kind"]}
    fixed = {"memories": ["depth", "content", "source_ref", "created_at", "dream_revision", "created_by_model", "origin_key"],
             "sources": ["content_hash", "relative_path", "created_at"], "relations": ["related_at", "run_id"]}
    out = []
    for table, key in keys.items():
        gone = old[table].join(new[table].select(*key), key, "left_anti")
        out.append(gone.select(F.lit(f"deleted {table}").alias("rule"), F.concat_ws("|", *key).alias("key")))
    for table, columns in fixed.items():
        key = keys[table]
        a = old[table].select(*key, F.struct(*columns).alias("a"))
        b = new[table].select(*key, F.struct(*columns).alias("b"))
        out.append(a.join(b, key).filter(~F.col("a").eqNullSafe(F.col("b")))
                   .select(F.lit(f"changed {table}").alias("rule"), F.concat_ws("|", *key).alias("key")))
    a = old["memories"].filter("sealed").select("id")
    b = new["memories"].filter(~F.col("sealed")).select("id")
    out.append(a.join(b, "id").select(F.lit("unsealed memory").alias("rule"), F.col("id").alias("key")))
    return _union(out)


def shared_corpus_mismatches(a_memories: DataFrame, b_memories: DataFrame, a_vectors: DataFrame,
                             b_vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """(memory_id, problem) for two corpora that should share their observations."""
    fields = ["depth", "source_ref", "content", "created_at", "created_by_model"]

    def side(memories: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
        v = vectors.select(F.col("memory_id").alias("id"), "vector")
        return (memories.filter("depth = 0").join(v, "id", "left")
                .select("id", F.struct(*fields).alias(f"{name}_row"), F.col("vector").alias(f"{name}_vector")))

    both = side(a_memories, a_vectors, "a").join(side(b_memories, b_vectors, "b"), "id", "full_outer")
    problem = (F.when(F.col("a_row").isNull(), "only in second").when(F.col("b_row").isNull(), "only in first")
               .when(~F.col("a_row").eqNullSafe(F.col("b_row")), "different memory")
               .when(~F.col("a_vector").eqNullSafe(F.col("b_vector")), "different vector"))
    differing = both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(F.col("id").alias("memory_id"), "problem")
    unmapped = (a_memories.filter("depth = 0").join(mapping.select(F.col("source_id").alias("source_ref")), "source_ref", "left_anti")
                .select(F.col("id").alias("memory_id"), F.lit("unmapped source").alias("problem")))
    return differing.unionByName(unmapped)


def corpus_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of depth-0 rows found in exactly one corpus."""
    columns = ["id", "content", "source_ref", "created_at"]
    left, right = (m.filter("depth = 0").select(*columns) for m in (a, b))
    return left.subtract(right).unionByName(right.subtract(left)).agg(F.count("*").alias("n"))


def set_equality(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of ``a``: does ``b`` hold exactly, or at least, the same values?

    Sets of any size: both sides are matched row by row and only counted.
    """
    left = a.select(key, value).distinct().withColumn("in_a", F.lit(True))
    right = b.select(key, value).distinct().withColumn("in_b", F.lit(True))
    return (left.join(right, [key, value], "full_outer").groupBy(key)
            .agg(F.count("in_a").alias("n"), F.count_if(F.col("in_b").isNull()).alias("only_a"),
                 F.count_if(F.col("in_a").isNull()).alias("only_b")).filter("n > 0")
            .select(key, ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"), (F.col("only_a") == 0).alias("subset")))
