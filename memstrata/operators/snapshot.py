"""Frozen corpus views and simple projections and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars as S


# ---- snapshots ------------------------------------------------------------

def snapshot_one(memories: DataFrame, relations: DataFrame, recalls: DataFrame,
                 run: dict | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three frozen tables of a single run; literal bounds reach the scan."""
    m, r, e = memories.filter("sealed"), relations, recalls
    if run is not None:
        m = m.filter(F.col("seq") <= run["memory_high_water"])
        r = r.filter(F.col("seq") <= run["relation_high_water"])
        e = e.filter(F.col("seq") <= run["recall_high_water"])
    return m, relation_edges(r, m), e


def relation_edges(relations: DataFrame, memories: DataFrame,
                   owners: DataFrame | None = None) -> DataFrame:
    """Relations with both ends visible; an extra selection limits owners only."""
    owner = (owners if owners is not None else memories).select(
        F.col("id").alias("memory_id"), F.col("depth").alias("owner_depth"))
    target = memories.select(F.col("id").alias("related_memory_id"), F.col("depth").alias("target_depth"))
    return relations.join(owner, "memory_id").join(target, "related_memory_id")


def restore_last_recalled(memories: DataFrame, recalls: DataFrame) -> DataFrame:
    last = recalls.groupBy(F.col("memory_id").alias("id")).agg(F.max("recalled_at").alias("last_recalled_at"))
    return memories.drop("last_recalled_at").join(last, "id", "left")


def relation_lists(edges: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` outgoing relations of each owner in order; the limit runs before the shuffle."""
    first = Window.partitionBy("memory_id").orderBy("seq")
    return (edges.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= cap).groupBy("memory_id")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "related_memory_id", "kind", "related_at"))).alias("relations")))


def parent_lists(derived_from: DataFrame, children: DataFrame) -> DataFrame:
    """Sorted parents of each child; a child has no more parents than its neighbourhood had members."""
    visible = children.select(F.col("id").alias("child_id"))
    return (derived_from.join(visible, "child_id")
            .groupBy("child_id").agg(F.array_sort(F.collect_list("parent_id")).alias("parents")))


def memory_records(memories: DataFrame, edges: DataFrame, derived_from: DataFrame,
                   roots: DataFrame) -> DataFrame:
    """Memories with the sizes of their parent, relation and root sets.

    The sets themselves stay tables keyed by memory: a memory may own any
    number of relations.
    """
    n = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    return (memories.join(n(derived_from, "child_id", "n_parents"), "id", "left")
            .join(n(edges, "memory_id", "n_relations"), "id", "left")
            .join(n(roots.distinct(), "memory_id", "unique_source_root_count"), "id", "left")
            .fillna(0, ["n_parents", "n_relations", "unique_source_root_count"]))


# ---- predicates -----------------------------------------------------------

def candidate_filter(memories: DataFrame, depth: int | None = None, exclude: str | None = None) -> DataFrame:
    out = memories
    if depth is not None:
        out = out.filter(F.col("depth") == depth)
    if exclude is not None:
        out = out.filter(F.col("id") != exclude)
    return out


def browse(memories: DataFrame, *, snapshot_seq: int | None = None, depth: int | None = None,
           revision: int | None = None, source: str | None = None, search: str | None = None) -> DataFrame:
    """Filtered memories; the search is a literal, case-sensitive substring."""
    if search is not None and len(search.encode("utf-16-le")) // 2 > 200:
        raise ValueError("search is limited to 200 characters")
    if (depth is not None and depth < 0) or (revision is not None and revision < 0):
        raise ValueError("depth and revision must not be negative")
    out = memories.filter("sealed")
    if snapshot_seq is not None:
        out = out.filter(F.col("seq") <= snapshot_seq)
    if depth is not None:
        out = out.filter(F.col("depth") == depth)
    if revision is not None:
        out = out.filter(F.col("dream_revision") == revision)
    if source is not None:
        out = out.filter(F.col("source_ref") == source)
    if search:
        out = out.filter(F.col("content").contains(search) | F.col("id").contains(search))
    return out


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 25) -> DataFrame:
    """One page by sort order: a top-n sort bounded by the page's end."""
    if page < 1:
        raise ValueError("page must be at least 1")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(df: DataFrame, page: int, size: int = 25) -> dict[str, int | bool]:
    """Total and page numbers of the bounded view the page was taken from."""
    total = df.count()
    pages = max(1, -(-total // size))
    return {"total": total, "pages": pages, "has_previous": page > 1, "has_next": page < pages}


def input_bounds(df: DataFrame, text: str, limit: int, required: bool = True) -> DataFrame:
    too_long = S.utf16_length(F.col(text)) > limit
    reason = F.when(too_long, "too_long")
    if required:
        reason = F.when(S.is_blank(F.col(text)), "blank").when(too_long, "too_long")
    return df.withColumn("reason", reason)


def memory_content_check(content: Column, model: Column, config: EngineConfig) -> Column:
    return (F.when(S.is_blank(content), "blank_content")
            .when(S.utf16_length(content) > config.max_memory_characters, "content_too_long")
            .when(S.is_blank(model), "blank_model"))


def lookup(memories: DataFrame, *, id: str | None = None, source: str | None = None,
           origin_key: str | None = None) -> DataFrame:
    out = memories.filter("sealed")
    for column, value in (("id", id), ("source_ref", source), ("origin_key", origin_key)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


# ---- payloads -------------------------------------------------------------

def evidence_payload(requests: DataFrame, edges: DataFrame, derived_from: DataFrame,
                     memories: DataFrame, cap: int) -> DataFrame:
    """Evidence of each request's visible memories.

    ``requests(request_id, memory_id)`` lists the visible set. Relations are
    filtered to visible targets before the cap; the rank limit runs before the
    shuffle of each group, so one owner's edges are never gathered whole.
    """
    visible = requests.select("request_id", F.col("memory_id").alias("related_memory_id"))
    owned = requests.join(edges, "memory_id")
    shown = owned.join(visible, ["request_id", "related_memory_id"])
    first = Window.partitionBy("request_id", "memory_id").orderBy("seq")
    rel = (shown.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= cap)
           .groupBy("request_id", "memory_id")
           .agg(F.array_sort(F.collect_list(F.struct("seq", "related_memory_id", "kind"))).alias("outgoing"),
                F.count("*").alias("n_shown")))
    totals = edges.groupBy("memory_id").agg(F.count("*").alias("n_relations"))
    parents = derived_from.select(F.col("child_id").alias("memory_id"), "parent_id")
    by_parent = Window.partitionBy("memory_id").orderBy("parent_id")
    par = (parents.withColumn("n", F.row_number().over(by_parent)).filter(F.col("n") <= cap)
           .groupBy("memory_id").agg(F.array_sort(F.collect_list("parent_id")).alias("parents")))
    par_totals = parents.groupBy("memory_id").agg(F.count("*").alias("n_parents"))
    base = requests.join(memories.select(F.col("id").alias("memory_id"), "depth", "content", "source_ref"), "memory_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (base.join(rel, ["request_id", "memory_id"], "left").join(totals, "memory_id", "left")
            .join(par, "memory_id", "left").join(par_totals, "memory_id", "left")
            .select("request_id", "memory_id", "depth", "content", "source_ref", "parents", "outgoing",
                    (zero("n_parents") - F.coalesce(F.size("parents"), F.lit(0))).alias("omitted_parent_count"),
                    (zero("n_relations") - zero("n_shown")).alias("omitted_relation_count")))


def priority_payload(work: DataFrame, memories: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (work item, outgoing relation), target fields null when absent.

    ``work(run_id, work_key, memory_id, period_start, period_end)``.
    """
    m = memories.select(F.col("id").alias("memory_id"), F.col("depth").alias("memory_depth"))
    t = memories.select(F.col("id").alias("related_memory_id"),
                        F.col("depth").alias("related_depth"), F.col("content").alias("related_content"))
    e = edges.select("memory_id", "seq", "related_memory_id", "kind", "related_at")
    return (work.join(m, "memory_id").filter((F.col("memory_depth") >= 1) & (F.col("period_start") < F.col("period_end")))
            .join(e, "memory_id", "left").join(t, "related_memory_id", "left"))
