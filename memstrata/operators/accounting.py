"""Exact-decimal call ledgers and corpus counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import USAGE, USD
from ..session import prefix_sums, running_ranges, side_by_side


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(USD)


def accounted() -> Column:
    return F.coalesce("actual_usd", "reserved_usd")


def run_accounted(calls: DataFrame) -> DataFrame:
    return calls.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(_sum(accounted()).alias("accounted_usd"))


def run_cost_split(calls: DataFrame) -> DataFrame:
    open_call = F.col("actual_usd").isNull()
    return calls.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        _sum(F.col("actual_usd")).alias("settled_usd"),
        _sum(F.when(open_call, F.col("reserved_usd"))).alias("unsettled_reserved_usd"),
        F.count_if(open_call).alias("unsettled_calls"), _sum(accounted()).alias("accounted_usd"))


def _usage_aggregates() -> list[Column]:
    usage = F.from_json("usage_json", USAGE)
    settled = F.col("actual_usd").isNotNull()
    tokens = lambda name: F.coalesce(F.sum(F.when(settled, usage[name])), F.lit(0)).cast("long")
    return [F.count("*").alias("calls"), _sum(F.col("actual_usd")).alias("settled_usd"),
            _sum(F.when(~settled, F.col("reserved_usd"))).alias("reserved_usd"),
            tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens")]


USAGE_FIELDS = ("calls", "settled_usd", "reserved_usd", "input_tokens", "output_tokens")


def usage_totals(calls: DataFrame, operation: str | None = None, by: list[str] | None = None) -> DataFrame:
    chosen = calls if operation is None else calls.filter(F.col("operation") == operation)
    return chosen.groupBy(*(by or [])).agg(*_usage_aggregates())


def usage_by_operation(calls: DataFrame) -> DataFrame:
    """Totals per operation with any scope prefix removed."""
    return (calls.withColumn("operation", F.substring_index("operation", "/", -1))
            .groupBy("operation").agg(*_usage_aggregates()))


def usage_subtract(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    right = b.select(key, *[F.col(f).alias(f"b_{f}") for f in USAGE_FIELDS])
    return a.join(right, key, "left").select(
        key, *[(S.usd_sub(F.col(f), F.coalesce(f"b_{f}", F.lit(0))) if f.endswith("usd")
                else F.col(f) - F.coalesce(f"b_{f}", F.lit(0))).alias(f) for f in USAGE_FIELDS])


def exposure_log(calls: DataFrame) -> DataFrame:
    """Two kinds of rows: a reservation (step 1) and what a settlement changes (step 0)."""
    reserve = calls.select("run_id", "id", "ordinal", F.col("created_at").alias("at"), F.lit(1).alias("step"),
                           F.col("reserved_usd").alias("amount"))
    settle = (calls.filter(F.col("completed_at").isNotNull())
              .select("run_id", "id", "ordinal", F.col("completed_at").alias("at"), F.lit(0).alias("step"),
                      S.usd_sub(F.col("actual_usd"), F.col("reserved_usd")).alias("amount")))
    return reserve.unionByName(settle)


def _timeline(events: DataFrame, budget: Column) -> DataFrame:
    after = S.usd_add(F.col("exposure_before"), F.col("amount"))
    return (events.filter("step = 1")
            .select("run_id", "id", "at", F.col("amount").alias("reserved_usd"),
                    F.col("exposure_before").cast(USD).alias("exposure_before"),
                    S.usd_sub(budget, after).alias("headroom"), (after > budget).alias("violates")))


def budget_timeline(calls: DataFrame, budget: Column) -> DataFrame:
    """Exposure before each call of a run, head-room and violation flag.

    A reservation counts in full until its settlement replaces it. Settlements
    at the same instant come first; equality with the budget is allowed.
    """
    log = exposure_log(calls).filter(F.col("run_id").isNotNull())
    return _timeline(prefix_sums(log, ["run_id"], F.date_trunc("hour", "at"),
                                 [F.col("at"), F.col("step"), F.col("ordinal")], F.col("amount"), "exposure_before"), budget)


def global_budget_timeline(calls: DataFrame, cap: Column) -> DataFrame:
    """The same for one cap over all calls, those without a run included.

    The log has no key to split by: it is cut into runs of its order, each
    summed on its own and shifted by the sums of the runs before it.
    """
    rows, ranges = running_ranges(exposure_log(calls), ["at", "step", "ordinal"], "amount")
    return _timeline(rows.join(ranges, "__range").withColumn(
        "exposure_before", S.usd_add(F.col("__shift"), F.col("__inside"))), cap)


def global_budget_breaches(calls: DataFrame, cap: Column) -> DataFrame:
    """The violating calls of ``global_budget_timeline`` alone, with the exposure after them.

    A run of the log whose highest exposure stays within the cap is left out
    before any of its rows is compared.
    """
    rows, ranges = running_ranges(exposure_log(calls), ["at", "step", "ordinal"], "amount")
    high = ranges.filter(S.usd_add(F.col("__shift"), F.col("__peak")) > cap)
    return _timeline(rows.join(high, "__range").withColumn(
        "exposure_before", S.usd_add(F.col("__shift"), F.col("__inside"))), cap).filter("violates").select(
        "run_id", "id", "at", S.usd_add(F.col("exposure_before"), F.col("reserved_usd")).alias("exposure"))


# ---- corpus counters ------------------------------------------------------------

def corpus_overview(memories: DataFrame, sources: DataFrame, relations: DataFrame) -> DataFrame:
    """(metric, n): table counts and memories per depth."""
    sealed = memories.filter("sealed")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    depth = (sealed.groupBy("depth").agg(F.count("*").alias("n"))
             .select(F.concat(F.lit("depth_"), F.col("depth")).alias("metric"), "n"))
    return one(sealed, "memories").unionByName(one(sources, "sources")).unionByName(
        one(relations, "relations")).unionByName(depth)


def root_counts(roots: DataFrame) -> DataFrame:
    return roots.groupBy("memory_id").agg(F.countDistinct("source_id").alias("unique_source_root_count"))


def memory_run_kind(memories: DataFrame, runs: DataFrame) -> DataFrame:
    kinds = runs.select(F.col("id").alias("dream_revision"), F.col("kind").alias("run_kind"))
    return memories.filter("depth > 0").join(kinds, "dream_revision")


def corpus_morphology(memories: DataFrame, relations: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of corpus shape."""
    m = memories.filter("sealed")
    shape = m.agg(F.count_if(F.col("depth") == 0).alias("depth0"), F.count_if(F.col("depth") == 1).alias("depth1"),
                  F.count_if(F.col("depth") >= 2).alias("depth2_plus"))
    rel = relations.agg(F.count_if(F.col("kind") == "positive").alias("positive_relations"),
                        F.count_if(F.col("kind") == "negative").alias("negative_relations"))
    made = memory_run_kind(m, runs).agg(
        F.count_if(F.col("run_kind") == "dream").alias("dream_memories"),
        F.count_if(F.col("run_kind") == "meditation").alias("meditation_memories"))
    n = sources.agg(F.count("*").alias("sources"))
    return side_by_side(n, shape, rel, made)


def observations_per_source(memories: DataFrame, mapped: DataFrame) -> DataFrame:
    """Depth-0 count of every mapped source, zeros kept."""
    n = (memories.filter("sealed and depth = 0").groupBy(F.col("source_ref").alias("source_id"))
         .agg(F.count("*").alias("n_observations")))
    return mapped.join(n, "source_id", "left").fillna(0, ["n_observations"])


def budget_rule(runs: DataFrame, calls: DataFrame, cap: str = "5") -> DataFrame:
    """Weekly runs that break the evaluation budget rule."""
    limit = F.lit(cap).cast(USD)
    spent = run_accounted(calls).withColumnRenamed("run_id", "id")
    return (runs.filter("kind = 'meditation'").join(spent, "id", "left")
            .withColumn("reason", F.when(F.col("budget_usd").isNull(), "no budget")
                        .when(F.col("budget_usd") > limit, "budget above the cap")
                        .when(F.col("accounted_usd") > limit, "cost above the cap"))
            .select("id", "budget_usd", F.coalesce("accounted_usd", F.lit(0)).cast(USD).alias("accounted_usd"), "reason"))


def run_summary(runs: DataFrame, run_work: DataFrame, rejected: DataFrame, calls: DataFrame,
                memories: DataFrame) -> DataFrame:
    """Per run: each child table is reduced to one row per run before it is joined."""
    work = run_work.groupBy(F.col("run_id").alias("id")).agg(
        F.count_if(F.col("status") == "complete").alias("completed_work"), F.count("*").alias("total_work"))
    rej = rejected.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("rejected_proposals"))
    cost = run_accounted(calls).withColumnRenamed("run_id", "id")
    made = (memories.filter("sealed and depth > 0").groupBy(F.col("dream_revision").alias("id"))
            .agg(F.count("*").alias("output_memories")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (runs.select("id", "kind", "status").join(work, "id", "left").join(rej, "id", "left")
            .join(cost, "id", "left").join(made, "id", "left")
            .select("id", "kind", "status", zero("completed_work"), zero("total_work"), zero("rejected_proposals"),
                    F.coalesce("accounted_usd", F.lit(0)).cast(USD).alias("accounted_usd"), zero("output_memories")))


def pruning_summary(run_work: DataFrame, runs: DataFrame, calls: DataFrame, memories: DataFrame) -> DataFrame:
    """Consolidation work of daily runs: total, skipped, empty and created."""
    from ..schemas import PROPOSAL
    dream = runs.filter("kind = 'dream'").select(F.col("id").alias("run_id"))
    proposal = F.from_json("proposal_json", PROPOSAL)
    work = (run_work.filter("phase = 'consolidation'").join(dream, "run_id").agg(
        F.count("*").alias("consolidation_work"),
        F.count_if(F.col("model") == "consolidation-ineligible").alias("infeasible"),
        F.count_if(F.col("model") == "dream-neighborhood-deduplicated").alias("deduplicated"),
        F.count_if(F.size(proposal["abstractions"]) == 0).alias("empty_responses")))
    spent = calls.filter(F.substring_index("operation", "/", -1) == "consolidation").agg(F.count("*").alias("consolidation_calls"))
    made = memory_run_kind(memories.filter("sealed"), runs).agg(F.count_if(F.col("run_kind") == "dream").alias("created_abstractions"))
    return side_by_side(work, spent, made)


# ---- many corpora -----------------------------------------------------------------

def execution_status(sources: DataFrame, memories: DataFrame, runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Progress per ``corpus_id`` and a total row (corpus_id null), one grouped job."""
    key = "corpus_id"
    s = sources.groupBy(key).agg(F.count_if(F.col("status") == "complete").alias("completed_sources"))
    m = memories.filter("sealed").groupBy(key).agg(F.count_if(F.col("depth") == 0).alias("depth0"),
                                                   F.count_if(F.col("depth") > 0).alias("higher_depth"))
    r = runs.groupBy(key).agg(
        F.count_if((F.col("kind") == "dream") & (F.col("status") == "complete")).alias("completed_dreams"),
        F.count_if((F.col("kind") == "meditation") & F.col("status").isin("complete", "budget_exhausted")).alias("finished_meditations"))
    c = usage_totals(calls, by=[key])
    fields = ["completed_sources", "depth0", "higher_depth", "completed_dreams", "finished_meditations", *USAGE_FIELDS]
    joined = s.join(m, key, "full_outer").join(r, key, "full_outer").join(c, key, "full_outer").fillna(0, [f for f in fields if not f.endswith("usd")])
    return joined.rollup(key).agg(*[_sum(F.col(f)).alias(f) if f.endswith("usd") else F.sum(f).alias(f) for f in fields])


def stopped_run_rollup(sources: DataFrame, memories: DataFrame, relations: DataFrame, runs: DataFrame,
                       calls: DataFrame) -> DataFrame:
    """Long-form group counts per corpus: (corpus_id, section, key, n, settled_usd, reserved_usd)."""
    none = F.lit(0).cast(USD)

    def counts(df: DataFrame, section: str, key: Column) -> DataFrame:
        return (df.groupBy("corpus_id", key.cast("string").alias("key")).agg(F.count("*").alias("n"))
                .select("corpus_id", F.lit(section).alias("section"), "key", "n", none.alias("settled_usd"), none.alias("reserved_usd")))

    kinds = runs.select("corpus_id", F.col("id").alias("dream_revision"), F.col("kind").alias("run_kind"))
    outputs = memories.filter("sealed and depth > 0").join(kinds, ["corpus_id", "dream_revision"])
    spent = (calls.rollup("operation", "corpus_id").agg(
        F.grouping("operation").alias("g"), F.count("*").alias("n"), _sum(F.col("actual_usd")).alias("settled_usd"),
        _sum(F.when(F.col("actual_usd").isNull(), F.col("reserved_usd"))).alias("reserved_usd"))
        .filter("g = 0").select("corpus_id", F.lit("calls").alias("section"), F.col("operation").alias("key"), "n", "settled_usd", "reserved_usd"))
    return (counts(sources, "sources", F.col("status")).unionByName(counts(memories.filter("sealed"), "memories", F.col("depth")))
            .unionByName(counts(relations, "relations", F.col("kind")))
            .unionByName(counts(runs, "runs", F.concat_ws("/", "kind", "status")))
            .unionByName(counts(outputs, "outputs", F.col("run_kind"))).unionByName(spent))
