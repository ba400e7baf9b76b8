"""Daily activity reports for all dates in one job: the date is a grouping key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph
from ..schemas import USAGE, USD
from ..session import prefix_sums


def on_date(df: DataFrame, at: str, zone: str) -> DataFrame:
    return df.withColumn("date", S.local_date(F.col(at), zone))


# ---- attribution ----------------------------------------------------------------

#: What the sections of a report read of the attributed calls.
ATTRIBUTED = ("created_at", "activity_id", "parent_kind", "actual_usd", "reserved_usd")


def linked_calls(calls: DataFrame, links: DataFrame) -> DataFrame:
    """Calls with their activity; unlinked calls keep nulls."""
    return calls.join(links.select(F.col("api_call_id").alias("id"), "activity_id", "settings_json"), "id", "left")


def attribute_calls(calls: DataFrame, links: DataFrame, operations: DataFrame) -> DataFrame:
    """Calls with their activity, its kind, work key and run; unlinked calls keep nulls. The owners go to the links, so a call travels once."""
    owner = operations.select(F.col("id").alias("activity_id"), F.col("kind").alias("parent_kind"),
                              F.col("work_key").alias("parent_work_key"), F.col("run_id").alias("parent_run_id"))
    owned = links.select(F.col("api_call_id").alias("id"), "activity_id", "settings_json").join(owner, "activity_id", "left")
    return calls.join(owned, "id", "left").select("activity_id", *calls.columns, "settings_json", "parent_kind", "parent_work_key", "parent_run_id")


def relation_category(results: DataFrame, memories: DataFrame) -> DataFrame:
    owner = memories.select(F.col("id").alias("memory_id"), F.col("depth").alias("o_depth"), F.col("source_ref").alias("o_source"))
    target = memories.select(F.col("id").alias("related_memory_id"), F.col("depth").alias("t_depth"), F.col("source_ref").alias("t_source"))
    category = (F.when(F.col("o_depth").isNull() | F.col("t_depth").isNull(), "unknown")
                .when((F.col("o_depth") > 0) & (F.col("t_depth") == 0), "abstraction_to_d0")
                .when((F.col("o_depth") == 0) & (F.col("t_depth") == 0),
                      F.when(F.col("o_source") == F.col("t_source"), "same_source_d0").otherwise("cross_source_d0"))
                .otherwise("other_depths"))
    return (results.join(owner, "memory_id", "left").join(target, "related_memory_id", "left")
            .withColumn("category", category).drop("o_depth", "o_source", "t_depth", "t_source"))


def source_cohort(sources: DataFrame, memories: DataFrame) -> DataFrame:
    """Observations visible now per source, zeros kept."""
    m = memories.filter("depth = 0").select(F.col("source_ref").alias("source_id"), "id")
    s = sources.select(F.col("id").alias("source_id"), "created_at")
    counts = m.groupBy("source_id").agg(F.count("id").alias("n_observations"))
    return s.join(counts, "source_id", "left").fillna(0, ["n_observations"])


def unattempted_work(run_work: DataFrame, operations: DataFrame) -> DataFrame:
    """Assimilation work without any recorded attempt, whenever the attempt was."""
    attempts = operations.filter("kind = 'assimilation'").select("run_id", "work_key").distinct()
    return run_work.filter("phase = 'assimilation'").join(attempts, ["run_id", "work_key"], "left_anti")


# ---- distributions ----------------------------------------------------------------

def nearest_rank(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, p50, p90 and max of an integer value per group by the nearest-rank rule.

    Equal values are counted before the shuffle and the running count goes by
    value ranges, so a group of any size is spread over many tasks.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*group).agg(F.sum("c").alias("n"), F.max(value).alias("max"))
    upto = prefix_sums(counts, group, F.shiftright(F.col(value).cast("long"), 10), [F.col(value)], F.col("c"), "before")
    at = lambda p: F.min(F.when(F.col("before") + F.col("c") >= F.ceil(F.col("n") * p / 10), F.col(value)))
    return upto.join(totals, group).groupBy(*group, "n", "max").agg(at(5).alias("p50"), at(9).alias("p90"))


def frequencies(values: DataFrame, group: list[str], value: str) -> DataFrame:
    return values.groupBy(*group, F.coalesce(F.col(value), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))


def frequency_map(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts as one ordered map per group; for columns with a small domain."""
    return frequencies(values, group, value).groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))


def counts_text(values: DataFrame, value: Column, name: str) -> DataFrame:
    """(date, name): how often each value of a small domain occurs, as ``value:n`` joined by commas in text order."""
    counted = values.groupBy("date", F.coalesce(value.cast("string"), F.lit("unknown")).alias("v")).agg(F.count("*").alias("n"))
    return counted.groupBy("date").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "v", "n"))), ",").alias(name))


def distribution(values: DataFrame, value: str, name: str) -> DataFrame:
    """(date, name_n, name_p50, name_p90, name_max)."""
    return nearest_rank(values, ["date"], value).select(
        "date", *[F.col(c).cast("long").alias(f"{name}_{c}") for c in ("n", "p50", "p90", "max")])


def _side_by_date(parts: list[DataFrame]) -> DataFrame:
    """One row per date; counts are 0 and texts empty where a part has none, quantiles stay null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "date", "full_outer")
    quantile = ("_p50", "_p90", "_max")
    texts = [c for c, t in out.dtypes if t == "string"]
    return out.fillna(0, [c for c, t in out.dtypes if t == "bigint" and not c.endswith(quantile)]).fillna("", texts)


# ---- summaries ------------------------------------------------------------------

def _n(condition: Column) -> Column:
    return F.count_if(condition)


def remember_summary(operations: DataFrame, sources: DataFrame, memories: DataFrame, zone: str) -> DataFrame:
    """Measures per date. ``sources`` carries raw_characters and raw_bytes, null when unknown."""
    d = F.col("details")
    ops = on_date(operations.filter(F.col("kind").isin("remember", "extraction")), "started_at", zone)
    said = (F.col("kind") == "remember") & (F.col("origin") == "agent")
    read = F.col("kind") == "extraction"
    none_made = F.coalesce(F.size(d["created_ids"]), F.lit(0)) <= 0
    activity = ops.groupBy("date").agg(
        _n(said).alias("observed_calls"),
        F.sum(F.when(said, F.coalesce(d["raw_characters"], F.lit(0))).otherwise(0)).alias("submitted_raw_characters"),
        F.sum(F.when(said, F.coalesce(d["raw_bytes"], F.lit(0))).otherwise(0)).alias("submitted_raw_bytes"),
        _n(said & d["raw_bytes"].isNull()).alias("unknown_raw_size_calls"),
        _n(said & d["new_source"]).alias("new_source_calls"),
        _n(said & ~d["new_source"] & F.col("source_id").isNotNull()).alias("reused_source_calls"),
        _n(read).alias("extraction_attempts"),
        _n(read & (F.col("status") == "complete") & none_made).alias("zero_observation_extractions"),
        _n(read & (F.col("origin") == "recovery")).alias("recovery_extraction_attempts"))
    stored = on_date(sources, "created_at", zone).groupBy("date").agg(
        F.count("*").alias("new_unique_sources"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("new_stored_raw_bytes_known"),
        F.coalesce(F.sum("raw_characters"), F.lit(0)).alias("new_stored_raw_characters_known"),
        _n(F.col("raw_bytes").isNull()).alias("new_source_size_unknown"))
    made = on_date(memories.filter("depth = 0"), "created_at", zone).groupBy("date").agg(F.count("*").alias("created_d0"))
    told = ops.filter(said).select("date", "status", d["raw_characters"].alias("raw_characters"), d["raw_bytes"].alias("raw_bytes"))
    cohort = on_date(source_cohort(sources, memories), "created_at", zone)
    return _side_by_date([
        activity, stored, made, counts_text(told, F.col("status"), "states"),
        distribution(told, "raw_characters", "raw_characters"), distribution(told, "raw_bytes", "raw_bytes"),
        distribution(cohort, "n_observations", "created_d0_per_new_source"),
        counts_text(on_date(sources, "created_at", zone), F.col("status"), "new_source_current_states"),
        counts_text(ops.filter(read), F.col("status"), "extraction_states")])


def recall_summary(operations: DataFrame, memories: DataFrame, zone: str) -> DataFrame:
    d = F.col("details")
    ops = on_date(operations.filter("kind = 'recall'"), "started_at", zone)
    done = F.col("status") == "complete"
    empty = lambda field: F.coalesce(F.size(d[field]), F.lit(0)) <= 0
    calls = ops.groupBy("date").agg(
        F.count("*").alias("observed_calls"),
        _n(done & empty("returned_ids")).alias("empty_completed_results"),
        _n(done & empty("candidate_ids")).alias("zero_candidate_completed_calls"),
        _n(done & ~empty("candidate_ids") & empty("returned_ids")).alias("candidates_but_zero_returned"))
    returned = returned_memories(operations, memories, zone)
    d0 = (returned.filter(F.col("depth") == "0").groupBy("date")
          .agg(F.sum("n").alias("returned_d0_total"), F.count("*").alias("returned_d0_distinct")))
    by_depth = returned.groupBy("date", "depth").agg(F.sum("n").alias("n")).groupBy("date").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "depth", "n"))), ",").alias("returned_by_depth"))
    return _side_by_date([calls, d0, by_depth, counts_text(ops, F.col("status"), "states")])


def returned_memories(operations: DataFrame, memories: DataFrame, zone: str) -> DataFrame:
    """(date, memory_id, depth or unknown, n): how often each id was returned."""
    ops = on_date(operations.filter("kind = 'recall'"), "started_at", zone)
    counts = (ops.select("date", F.explode("details.returned_ids").alias("memory_id"))
              .groupBy("date", "memory_id").agg(F.count("*").alias("n")))
    known = memories.select(F.col("id").alias("memory_id"), F.col("depth").cast("string").alias("depth"))
    return counts.join(known, "memory_id", "left").fillna("unknown", ["depth"])


def report_runs(operations: DataFrame, linked: DataFrame, calls: DataFrame, runs: DataFrame, zone: str) -> DataFrame:
    """(date, run_id): runs named by the day's connected operations, its calls, or started that day."""
    ops = linked.join(operations.select("id", "run_id", "charged_run_id"), "id")
    named = (ops.select("date", "run_id").unionByName(ops.select("date", F.col("charged_run_id").alias("run_id")))
             .unionByName(on_date(calls, "created_at", zone).select("date", "run_id"))
             .unionByName(on_date(runs, "started_at", zone).select("date", F.col("id").alias("run_id"))))
    return named.filter(F.col("run_id").isNotNull()).distinct()


def assimilation_summary(operations: DataFrame, attributed: DataFrame, run_work: DataFrame, day_runs: DataFrame,
                         results: DataFrame, memories: DataFrame, zone: str) -> DataFrame:
    """Measures per date; work states are those of the runs the day refers to."""
    d = F.col("details")
    ops = on_date(operations.filter("kind = 'assimilation'"), "started_at", zone)
    calls = (on_date(attributed.filter("parent_kind = 'assimilation'"), "created_at", zone)
             .groupBy("date").agg(F.count("*").alias("linked_api_reservations")))
    attempts = ops.groupBy("date").agg(
        F.count("*").alias("attempts"), _n(d["model_invoked"]).alias("model_invoked_attempts"),
        _n(d["proposal_reused"]).alias("proposal_reused_attempts"),
        _n((F.col("status") == "complete") & (F.size(d["relations"]) == 0)).alias("completed_zero_proposal_attempts"))
    logical = (ops.select("date", "run_id", "work_key").distinct().groupBy("date").agg(F.count("*").alias("logical_work_count")))
    # work is reduced to one row per run before it meets the dates
    open_work = unattempted_work(run_work, operations).groupBy("run_id").agg(F.count("*").alias("u"))
    per_run = (run_work.filter("phase = 'assimilation'").groupBy("run_id").agg(
        F.count("*").alias("w"), _n(F.col("status") == "complete").alias("c")).join(open_work, "run_id", "left"))
    work = day_runs.join(per_run, "run_id").groupBy("date").agg(
        F.coalesce(F.sum("u"), F.lit(0)).alias("referenced_run_work_without_recorded_attempt_as_of"))
    by_state = (run_work.filter("phase = 'assimilation'").groupBy("run_id", F.coalesce("status", F.lit("unknown")).alias("status"))
                .agg(F.count("*").alias("c")))
    work_states = (day_runs.join(by_state, "run_id").groupBy("date", "status").agg(F.sum("c").alias("n")).groupBy("date")
                   .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "status", "n"))), ",").alias("referenced_run_work_states_as_of")))
    ended = on_date(results, "at", zone)
    outcomes = ended.groupBy("date").agg(F.count("*").alias("relation_results_at_execution_date"))
    appended = relation_category(ended.filter("outcome = 'appended'"), memories)
    return _side_by_date([attempts, logical, calls, work, work_states, outcomes, counts_text(ops, F.col("status"), "states"),
                          counts_text(ended, F.col("outcome"), "outcomes"), counts_text(appended, F.col("category"), "appended_categories")])


def _usd(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(USD)


def cost_summary(attributed: DataFrame, operations: DataFrame, sources: DataFrame, zone: str) -> DataFrame:
    """Costs per date and the two workload ratios, null when nothing was counted."""
    open_call = F.col("actual_usd").isNull()
    loose = F.col("activity_id").isNull()
    calls = on_date(attributed, "created_at", zone).groupBy("date").agg(
        F.count("*").alias("api_calls"), _usd(F.col("actual_usd")).alias("actual_usd"),
        _usd(F.when(open_call, F.col("reserved_usd"))).alias("unsettled_reserved_usd"),
        _n(open_call).alias("unsettled_calls"), _n(loose).alias("unattributed_calls"),
        _usd(F.when(loose, F.col("actual_usd"))).alias("unattributed_actual_usd"),
        _usd(F.when(F.col("parent_kind") == "assimilation", F.col("actual_usd"))).alias("assimilation_actual_usd"))
    new = on_date(sources, "created_at", zone).groupBy("date").agg(F.count("*").alias("new_sources"))
    works = (on_date(operations.filter("kind = 'assimilation'"), "started_at", zone).select("date", "run_id", "work_key").distinct()
             .groupBy("date").agg(F.count("*").alias("works")))
    out = calls.join(new, "date", "left").join(works, "date", "left").fillna(0, ["new_sources", "works"])
    ratio = lambda a, b: F.try_divide(F.col(a).cast("decimal(24,12)"), F.col(b).cast("decimal(12,0)")).cast("decimal(30,12)")
    return (out.withColumn("actual_usd_per_new_source", ratio("actual_usd", "new_sources"))
            .withColumn("actual_usd_per_assimilation_work", ratio("assimilation_actual_usd", "works")))


def stage_costs(attributed: DataFrame, zone: str) -> DataFrame:
    usage = F.from_json("usage_json", USAGE)
    tokens = lambda name: F.coalesce(F.sum(usage[name]), F.lit(0)).cast("long").alias(name)
    return (on_date(attributed, "created_at", zone)
            .withColumn("parent", F.coalesce("parent_kind", F.lit("unattributed")))
            .groupBy("date", "parent", F.coalesce("operation", F.lit("unknown")).alias("operation")).agg(
                F.count("*").alias("api_calls"), _usd(F.col("actual_usd")).alias("actual_usd"),
                _usd(F.when(F.col("actual_usd").isNull(), F.col("reserved_usd"))).alias("unsettled_reserved_usd"),
                tokens("input_tokens"), tokens("cached_input_tokens"), tokens("cache_write_tokens"), tokens("output_tokens"),
                _n(F.col("usage_json").isNull()).alias("usage_unknown_calls")))


def coverage_status(dates: DataFrame, started: Column, today: Column) -> DataFrame:
    """Instrumentation coverage of each date; ``started`` is a local date or null."""
    status = (F.when(started.isNull() | (started > F.col("date")), "unknown_legacy")
              .when(started == F.col("date"), "partial_from_instrumentation_start").otherwise("instrumented"))
    return dates.withColumn("coverage", status).withColumn("provisional", F.col("date") >= today)


#: What a section knows without recorded activity; its other measures are null before that.
KNOWN_BEFORE = {
    "remember": ("observed_calls", "new_unique_sources", "new_stored_raw_bytes_known", "new_stored_raw_characters_known", "new_source_size_unknown",
                 "created_d0", "created_d0_per_new_source_n", "created_d0_per_new_source_p50", "created_d0_per_new_source_p90",
                 "created_d0_per_new_source_max", "new_source_current_states"),
    "recall": ("observed_calls",),
    "assimilation": (),
}


def mask_legacy(summary: DataFrame, section: str) -> DataFrame:
    """Null out what cannot be known before instrumentation; corpus and cost values stay."""
    legacy = F.col("coverage") == "unknown_legacy"
    kept = ("date", "coverage", "provisional", *KNOWN_BEFORE[section])
    return summary.withColumns({c: F.when(~legacy, F.col(c)) for c in summary.columns if c not in kept})


# ---- closures ------------------------------------------------------------------

def day_operations(operations: DataFrame, attributed: DataFrame, zone: str) -> DataFrame:
    """(date, id): the day's operations, the owners of its calls, and everything connected."""
    own = on_date(operations, "started_at", zone).select("date", "id")
    paid = (on_date(attributed.filter(F.col("activity_id").isNotNull()), "created_at", zone)
            .select("date", F.col("activity_id").alias("id")))
    return graph.activity_components(operations, own.unionByName(paid).distinct())


def report_memories(operations: DataFrame, linked: DataFrame, day_runs: DataFrame, run_work: DataFrame,
                    results: DataFrame, memories: DataFrame, derived_from: DataFrame, zone: str) -> DataFrame:
    """(date, memory_id): every memory a day's report refers to, with all ancestors."""
    ops = linked.join(operations.select("id", "run_id", "work_key", "details"), "id")
    listed = ops.select("date", F.explode(F.concat(
        F.coalesce("details.created_ids", F.array()), F.coalesce("details.returned_ids", F.array()),
        F.coalesce("details.candidate_ids", F.array()),
        F.when(F.col("details.seed_id").isNotNull(), F.array("details.seed_id")).otherwise(F.array().cast("array<string>")))).alias("memory_id"))
    created = on_date(memories, "created_at", zone).select("date", F.col("id").alias("memory_id"))
    seeds = day_runs.join(run_work.select("run_id", "memory_id"), "run_id").select("date", "memory_id")
    works = ops.filter(F.col("run_id").isNotNull() & F.col("work_key").isNotNull()).select("date", "run_id", "work_key").distinct()
    ends = F.explode(F.array("memory_id", "related_memory_id"))
    that_day = on_date(results, "at", zone).select("date", ends.alias("memory_id"))
    by_work = works.join(results.select("run_id", "work_key", "memory_id", "related_memory_id"), ["run_id", "work_key"]).select(
        "date", ends.alias("memory_id"))
    named = listed.unionByName(created).unionByName(seeds).unionByName(that_day).unionByName(by_work).distinct()
    closure = graph.ancestor_closure(named.select(F.col("date").alias("start"), "memory_id"), derived_from,
                                     graph.max_depth(memories))
    return closure.select(F.col("start").alias("date"), "memory_id")


def report_sources(closure: DataFrame, linked: DataFrame, operations: DataFrame, memories: DataFrame) -> DataFrame:
    by_memory = closure.join(memories.filter("source_ref is not null").select(F.col("id").alias("memory_id"), F.col("source_ref").alias("source_id")), "memory_id").select("date", "source_id")
    by_operation = linked.join(operations.select("id", "source_id"), "id").filter("source_id is not null").select("date", "source_id")
    return by_memory.unionByName(by_operation).distinct()


# ---- refresh ---------------------------------------------------------------------

def fingerprints(report: DataFrame) -> DataFrame:
    """(date, fingerprint) over the content columns in a fixed order."""
    columns = sorted(c for c in report.columns if c not in ("date", "as_of", "snapshot_id"))
    return report.select("date", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def changed_days(report: DataFrame, prior: DataFrame, start: Column, today: Column) -> DataFrame:
    """Closed days since coverage start whose fingerprint is missing or different."""
    closed = report.filter((F.col("date") >= start) & (F.col("date") < today))
    return fingerprints(closed).join(prior.select("date", "fingerprint"), ["date", "fingerprint"], "left_anti")


def date_range(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def report_frame(dates: DataFrame, **sections: DataFrame) -> DataFrame:
    """One row per date with each section's measures prefixed by its name."""
    out = dates
    for name, frame in sections.items():
        renamed = frame.select("date", *[F.col(c).alias(f"{name}_{c}") for c in frame.columns if c != "date"])
        out = out.join(renamed, "date", "left")
    return out


def daily_report(operations: DataFrame, sources: DataFrame, memories: DataFrame, attributed: DataFrame, run_work: DataFrame,
                 day_runs: DataFrame, results: DataFrame, zone: str, started: Column, today: Column) -> DataFrame:
    """The whole report: one row per date that any section knows, with coverage and masked activity measures."""
    sections = {
        "remember": remember_summary(operations, sources, memories, zone),
        "recall": recall_summary(operations, memories, zone),
        "assimilation": assimilation_summary(operations, attributed, run_work, day_runs, results, memories, zone),
        "costs": cost_summary(attributed, operations, sources, zone),
    }
    dates = None
    for frame in sections.values():
        dates = frame.select("date") if dates is None else dates.unionByName(frame.select("date"))
    dates = coverage_status(dates.distinct(), started, today)
    masked = {}
    for name, frame in sections.items():
        with_coverage = frame.join(dates, "date")
        if name in KNOWN_BEFORE:
            with_coverage = mask_legacy(with_coverage, name)
        masked[name] = with_coverage.drop("coverage", "provisional")
    return report_frame(dates, **masked)
