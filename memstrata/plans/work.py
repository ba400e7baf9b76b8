"""Work planning: which memories a period's run has to look at, in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import numbered, prefix_sums

WORK_COLUMNS = ("run_id", "work_key", "phase", "memory_id", "ordinal")


# ---- runs -------------------------------------------------------------------

def with_high_water(runs: DataFrame, events: DataFrame, at: str, name: str) -> DataFrame:
    """Largest ``seq`` before each run's period end; 0 when there is none.

    Events are reduced to one row per day first. Days before the end day are
    covered by a running maximum over that small table, the end day itself by
    its own rows.
    """
    daily = events.groupBy(F.to_date(at).alias("day")).agg(F.max("seq").alias("day_max"))
    ends = runs.select("id", "period_end", F.to_date("period_end").alias("end_day"))
    marks = (daily.select("day", "day_max", F.lit(None).cast("long").alias("id"))
             .unionByName(ends.select(F.date_sub("end_day", 1).alias("day"), F.lit(None).cast("long").alias("day_max"), "id"))
             .withColumn("before", F.max("day_max").over(
                 Window.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
             .filter(F.col("id").isNotNull()).select("id", "before"))
    partial = (ends.filter(F.col("period_end") > F.col("end_day").cast("timestamp"))
               .join(events.select(F.to_date(at).alias("end_day"), F.col(at).alias("at"), F.col("seq").alias("s")), "end_day")
               .filter(F.col("at") < F.col("period_end")).groupBy("id").agg(F.max("s").alias("same_day")))
    return (runs.join(marks, "id", "left").join(partial, "id", "left")
            .withColumn(name, F.coalesce(F.greatest("before", "same_day"), F.lit(0)).cast("long"))
            .drop("before", "same_day"))


def get_or_create_runs(requests: DataFrame, runs: DataFrame, memories: DataFrame,
                       relations: DataFrame, recalls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with the new ones, rejected requests).

    Unique by (kind, start, end). A new run freezes the three current maxima.
    """
    reason = (F.when(~F.col("kind").isin("dream", "meditation"), "unknown kind")
              .when(F.col("period_start") >= F.col("period_end"), "empty period")
              .when((F.col("kind") == "meditation") & F.coalesce(F.col("budget_usd") <= 0, F.lit(True)), "budget required"))
    judged = requests.withColumn("reason", reason)
    rejected = judged.filter(F.col("reason").isNotNull())
    key = ["kind", "period_start", "period_end"]
    fresh = (judged.filter(F.col("reason").isNull()).drop("reason").dropDuplicates(key)
             .join(runs.select(*key), key, "left_anti"))
    top = lambda df: df.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # requests are the few periods that became due, not corpus rows
    order = Window.orderBy("period_end", "kind", "period_start")
    created = fresh.select(
        (F.lit(last) + F.row_number().over(order)).cast("long").alias("id"), *key,
        F.lit(top(memories)).cast("long").alias("memory_high_water"),
        F.lit(top(relations)).cast("long").alias("relation_high_water"),
        F.lit(top(recalls)).cast("long").alias("recall_high_water"),
        F.lit("running").alias("status"),
        F.when(F.col("kind") == "meditation", F.col("budget_usd")).cast("decimal(38,12)").alias("budget_usd"))
    return runs.select(*created.columns).unionByName(created), rejected


def in_run_period(df: DataFrame, at: str, runs: DataFrame) -> DataFrame:
    """Rows with the run whose half-open period holds them.

    The range condition becomes an equi join on the calendar day; run periods
    are listed by day, and only the first and last day need the exact test.
    """
    by_day = runs.select(
        F.col("id").alias("run_id"), "period_start", "period_end", "memory_high_water",
        "relation_high_water", "recall_high_water",
        F.explode(F.sequence(F.to_date("period_start"), F.to_date("period_end"))).alias("day"))
    return (df.withColumn("day", F.to_date(at)).join(by_day, "day")
            .filter(S.in_period(F.col(at), F.col("period_start"), F.col("period_end"))).drop("day"))


# ---- daily work ---------------------------------------------------------------

def seed_union(memories: DataFrame, recalls: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, memory_id, created_at): created observations and recalled memories of each run."""
    m = memories.filter("sealed").select(F.col("id").alias("memory_id"), "seq", "depth", "created_at")
    created = (in_run_period(m.filter("depth = 0"), "created_at", runs)
               .filter(F.col("seq") <= F.col("memory_high_water")).select("run_id", "memory_id", "created_at"))
    recalled = (in_run_period(recalls, "recalled_at", runs)
                .filter(F.col("seq") <= F.col("recall_high_water"))
                .select("run_id", "memory_id", "memory_high_water").distinct()
                .join(m, "memory_id").filter(F.col("seq") <= F.col("memory_high_water"))
                .select("run_id", "memory_id", "created_at"))
    return created.unionByName(recalled).distinct()


def number_work(work: DataFrame) -> DataFrame:
    """0-based ordinals inside each run in key order, split by the head of the key.

    The head reaches four characters into the memory's id, behind the words
    that all keys of a kind share; carried work has more of those.
    """
    head = F.regexp_extract("work_key", r"^(?:carry:\d+:)?[a-z]+:(?:mem_)?.{0,4}", 0)
    out = prefix_sums(work, ["run_id"], F.when(head == "", F.substring("work_key", 1, 18)).otherwise(head), [F.col("work_key")], F.lit(1).cast("long"), "ordinal")
    return out.withColumn("ordinal", F.col("ordinal").cast("int"))


def dream_plan(memories: DataFrame, recalls: DataFrame, runs: DataFrame,
               initialised: DataFrame | None = None) -> DataFrame:
    """Work rows of all daily runs: assimilation of the day's observations
    first, then consolidation of all seeds, each by (created_at, id)."""
    dream = runs.filter("kind = 'dream'")
    if initialised is not None:
        dream = dream.join(initialised.select(F.col("run_id").alias("id")), "id", "left_anti")
    m = memories.filter("sealed").select(F.col("id").alias("memory_id"), "seq", "depth", "created_at")
    created = (in_run_period(m.filter("depth = 0"), "created_at", dream)
               .filter(F.col("seq") <= F.col("memory_high_water")))
    first = created.select("run_id", F.lit(0).alias("phase_no"), "memory_id", "created_at")
    second = seed_union(memories, recalls, dream).select("run_id", F.lit(1).alias("phase_no"), "memory_id", "created_at")
    # keys follow from phase and memory: they are made after the numbering, which shuffles the rows
    assimilated = F.col("phase_no") == 0
    return work_ordinals(first.unionByName(second)).withColumns({
        "phase": F.when(assimilated, "assimilation").otherwise("consolidation"),
        "work_key": F.concat(F.when(assimilated, "assimilate:").otherwise("abstract:"), F.col("memory_id"))}).select(*WORK_COLUMNS)


def work_ordinals(work: DataFrame) -> DataFrame:
    """Dense positions by (phase, created_at, id) without gathering a run.

    A run may hold a third of all work, so the position is split: rows are
    numbered inside (run, phase, hour) and shifted by the counts before.
    """
    order = [F.col("created_at"), F.col("memory_id")]
    numbered = prefix_sums(
        work.withColumn("hour", F.date_trunc("hour", "created_at")), ["run_id"],
        F.struct("phase_no", "hour"), order, F.lit(1).cast("long"), "ordinal")
    return numbered.withColumn("ordinal", F.col("ordinal").cast("int")).drop("hour")


# ---- weekly work ----------------------------------------------------------------

def changed_memories(memories: DataFrame, relations: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, memory_id): abstractions created in the period, or whose own
    outgoing relations grew in it; only the owner's depth counts."""
    m = memories.filter("sealed").select(F.col("id").alias("memory_id"), "seq", "depth", "created_at").filter("depth >= 1")
    created = (in_run_period(m, "created_at", runs).filter(F.col("seq") <= F.col("memory_high_water"))
               .select("run_id", "memory_id"))
    target = memories.filter("sealed").select(F.col("id").alias("related_memory_id"), F.col("seq").alias("target_seq"))
    grown = (in_run_period(relations.select("memory_id", "related_memory_id", F.col("seq").alias("rel_seq"), "related_at"),
                           "related_at", runs)
             .filter(F.col("rel_seq") <= F.col("relation_high_water"))
             .join(target, "related_memory_id").filter(F.col("target_seq") <= F.col("memory_high_water"))
             .select("run_id", "memory_id", "memory_high_water").distinct()
             .join(m.select("memory_id", "seq"), "memory_id").filter(F.col("seq") <= F.col("memory_high_water"))
             .select("run_id", "memory_id"))
    return created.unionByName(grown).distinct()


def changed_work(memories: DataFrame, relations: DataFrame, runs: DataFrame) -> DataFrame:
    changed = changed_memories(memories, relations, runs.filter("kind = 'meditation'"))
    return changed.select("run_id", F.concat(F.lit("abstract:"), F.col("memory_id")).alias("work_key"),
                          F.lit("consolidation").alias("phase"), "memory_id")


def carry_work(run_work: DataFrame, runs: DataFrame, memories: DataFrame, targets: list[int]) -> DataFrame:
    """Unfinished work of earlier budget-exhausted runs, under its own keys.

    ``targets`` are the weekly runs that pick the work up; each takes
    everything left by earlier runs.
    """
    origin = runs.filter("kind = 'meditation' and status = 'budget_exhausted'").select(
        F.col("id").alias("origin_run"), "memory_high_water")
    left = (run_work.filter((F.col("status") != "complete") & ~F.col("work_key").startswith("carry:"))
            .select(F.col("run_id").alias("origin_run"), "work_key", "memory_id").join(origin, "origin_run"))
    kept = (left.join(memories.filter("sealed").select(F.col("id").alias("memory_id"), "seq"), "memory_id")
            .filter(F.col("seq") <= F.col("memory_high_water")))
    takers = F.filter(F.array(*[F.lit(t).cast("long") for t in targets]), lambda t: t > F.col("origin_run"))
    return kept.withColumn("run_id", F.explode(takers)).select(
        "run_id", F.concat(F.lit("carry:"), F.col("origin_run"), F.lit(":"), F.col("work_key")).alias("work_key"),
        F.lit("carry").alias("phase"), "memory_id")


def meditation_candidates(memories: DataFrame, relations: DataFrame, runs: DataFrame,
                          run_work: DataFrame, targets: list[int]) -> DataFrame:
    """Changed memories and carried work, listed apart even for the same memory."""
    chosen = runs.filter(F.col("id").isin(targets))
    return (changed_work(memories, relations, chosen)
            .unionByName(carry_work(run_work, runs, memories, targets)))


def validate_priority(candidates: DataFrame, orders: DataFrame) -> DataFrame:
    """Per run: is the returned order an exact permutation of the work keys?

    ``orders(run_id, position, work_key)``.
    """
    given = orders.groupBy("run_id", "work_key").agg(F.count("*").alias("n_given"))
    wanted = candidates.select("run_id", "work_key").withColumn("wanted", F.lit(1))
    return (wanted.join(given, ["run_id", "work_key"], "full_outer")
            .groupBy("run_id").agg(
                F.count_if(F.col("n_given").isNull()).alias("missing"),
                F.count_if(F.col("wanted").isNull()).alias("unknown"),
                F.sum(F.when(F.col("n_given") > 1, F.col("n_given") - 1).otherwise(0)).alias("duplicate"))
            .withColumn("ok", (F.col("missing") + F.col("unknown") + F.col("duplicate")) == 0))


def meditation_plan(candidates: DataFrame, orders: DataFrame) -> DataFrame:
    """Ordinals from the validated order; runs with an invalid order are left out."""
    verdict = validate_priority(candidates, orders).filter("ok").select("run_id")
    return (candidates.join(verdict, "run_id", "left_semi")
            .join(orders.select("run_id", "work_key", F.col("position").cast("int").alias("ordinal")), ["run_id", "work_key"])
            .select(*WORK_COLUMNS))


def close_unprioritised(candidates: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the candidates pending in key order and close their runs.

    Only running, uninitialised weekly runs may be closed this way.
    """
    open_runs = runs.filter("kind = 'meditation' and status = 'running' and not work_initialized")
    held = candidates.join(open_runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    work = number_work(held).withColumn("status", F.lit("pending"))
    hit = held.select(F.col("run_id").alias("id")).distinct().withColumn("closed", F.lit(True))
    closed = (runs.join(hit, "id", "left")
              .withColumn("status", F.when(F.col("closed"), "budget_exhausted").otherwise(F.col("status")))
              .withColumn("work_initialized", F.col("work_initialized") | F.coalesce("closed", F.lit(False)))
              .drop("closed"))
    return work, closed


def resolve_carry(run_work: DataFrame) -> DataFrame:
    """Carry items with the live status of the item they stand for."""
    carry = run_work.filter(F.col("work_key").startswith("carry:"))
    original = run_work.filter(~F.col("work_key").startswith("carry:")).select(
        F.col("run_id").alias("evidence_run_id"), F.col("work_key").alias("original_key"),
        F.col("status").alias("original_status"), F.col("model").alias("original_model"))
    return (carry.withColumn("evidence_run_id", S.carry_run(F.col("work_key")))
            .withColumn("original_key", S.carry_original_key(F.col("work_key")))
            .join(original, ["evidence_run_id", "original_key"], "left")
            .select(F.col("run_id").alias("charged_run_id"), "work_key", "evidence_run_id", "original_key",
                    "memory_id", "original_status", "original_model",
                    F.when(F.col("original_status") == "complete", "complete").otherwise(F.col("status")).alias("resolved_status"),
                    F.col("original_status").isNull().alias("broken")))


# ---- calendar ---------------------------------------------------------------------

def calendar_anchor(memories: DataFrame, sources: DataFrame, first_source_at: Column | None,
                    today: Column, zone: str) -> DataFrame:
    """Earliest local date of any activity, today at the latest."""
    dates = (memories.filter("sealed").agg(F.min("created_at").alias("at"))
             .unionByName(sources.filter(F.col("status").isin("pending", "failed")).agg(F.min("created_at").alias("at"))))
    first = dates.agg(F.min(S.local_date(F.col("at"), zone)).alias("d"))
    extra = [] if first_source_at is None else [S.local_date(first_source_at, zone)]
    return first.select(F.least(F.col("d"), today, *extra).alias("anchor"))


def due_periods(cursors: DataFrame, zone: str) -> DataFrame:
    """Closed local days and complete weeks that still have to run, in order.

    ``cursors(corpus_id, next_day, next_week, today, budget_usd)``; weeks start
    at the anchor and follow right after their seventh day. Without a budget
    weeks stay pending.
    """
    dreams = (cursors.filter(F.col("next_day") < F.col("today"))
              .select("corpus_id", F.explode(F.sequence("next_day", F.date_sub("today", 1))).alias("first_day"))
              .select("corpus_id", F.lit("dream").alias("kind"), "first_day", F.date_add("first_day", 1).alias("end_day")))
    weeks = (cursors.filter(F.col("budget_usd").isNotNull() & (F.date_add("next_week", 7) <= F.col("today")))
             .select("corpus_id", "next_day", F.explode(F.expr(
                 "sequence(next_week, date_sub(today, 7), interval 7 days)")).alias("first_day"))
             .select("corpus_id", F.lit("meditation").alias("kind"), "first_day",
                     F.date_add("first_day", 7).alias("end_day"), "next_day"))
    # a week that ended before the daily cursor waits for the next closed day
    last_day = dreams.groupBy("corpus_id").agg(F.min("end_day").alias("next_close"))
    due = (weeks.join(last_day, "corpus_id")
           .select("corpus_id", "kind", "first_day", "end_day", F.greatest("end_day", "next_close").alias("runs_after")))
    plan = dreams.withColumn("runs_after", F.col("end_day")).unionByName(due)
    order = Window.partitionBy("corpus_id").orderBy("runs_after", F.col("kind"), "first_day")
    return (plan.withColumn("position", F.row_number().over(order))
            .withColumn("period_start", S.local_day_start(F.col("first_day"), zone))
            .withColumn("period_end", S.local_day_start(F.col("end_day"), zone)))


def replay_day_plan(sessions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Sessions and UTC midnights of each question in replay order.

    A midnight comes before a session at the same instant and closes a day
    only up to the question's cutoff.
    """
    first = sessions.groupBy("question_id").agg(F.min("ts").alias("first_ts"))
    midnights = (first.join(cutoffs, "question_id")
                 .withColumn("from_day", F.date_add(F.to_date("first_ts"), 1))
                 .filter(F.col("from_day").cast("timestamp") <= F.col("cutoff"))
                 .select("question_id", F.explode(F.sequence("from_day", F.to_date("cutoff"))).alias("day"))
                 .select("question_id", F.col("day").cast("timestamp").alias("at"), F.lit(0).alias("order_class"),
                         F.lit(None).cast("int").alias("ordinal"), F.lit("close_day").alias("event"),
                         F.lit(None).cast("string").alias("session_id")))
    said = sessions.select("question_id", F.col("ts").alias("at"), F.lit(1).alias("order_class"),
                           "ordinal", F.lit("session").alias("event"), "session_id")
    return numbered(midnights.unionByName(said), ["question_id"], F.to_date("at"),
                    [F.col("at"), F.col("order_class"), F.col("ordinal")])


def active_day_plan(memories: DataFrame, recalls: DataFrame, cutoff: Column) -> DataFrame:
    """UTC days with new observations or recalls that are closed by the cutoff."""
    made = memories.filter("depth = 0").select(F.to_date("created_at").alias("day"), F.lit(1).alias("c"), F.lit(0).alias("r"))
    used = recalls.select(F.to_date("recalled_at").alias("day"), F.lit(0).alias("c"), F.lit(1).alias("r"))
    return (made.unionByName(used).groupBy("day")
            .agg(F.sum("c").alias("observations"), F.sum("r").alias("recalls"))
            .filter(F.date_add("day", 1).cast("timestamp") <= cutoff))


# ---- source lifecycle -------------------------------------------------------------

def source_lifecycle(events: DataFrame, slot_size: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(current status, steps with validity) from ``events(source_id, seq, status)``.

    A claim succeeds from pending or failed, a result only from processing,
    and complete is final. Because complete is final and every claim of an
    unfinished source leaves it in processing, the state before an event
    follows from the event just before it, from whether a claim was ever made
    and from the first result that ended a claim with complete.
    """
    moves = events.filter("status <> 'pending'").withColumn("slot", F.floor(F.col("seq") / slot_size))
    # the previous event: inside the slot, else the last one of an earlier slot
    ends = moves.groupBy("source_id", "slot").agg(F.max_by("status", "seq").alias("end"))
    ends = ends.withColumn("carried", F.lag("end").over(Window.partitionBy("source_id").orderBy("slot"))).drop("end")
    inside = Window.partitionBy("source_id", "slot").orderBy("seq")
    tagged = (moves.withColumn("inner", F.lag("status").over(inside)).join(ends, ["source_id", "slot"])
              .withColumn("previous", F.coalesce("inner", "carried")))
    marks = tagged.groupBy("source_id").agg(
        F.min(F.when(F.col("status") == "processing", F.col("seq"))).alias("first_claim"),
        F.min(F.when((F.col("status") == "complete") & (F.col("previous") == "processing"), F.col("seq"))).alias("done"))
    steps = tagged.join(marks, "source_id").withColumn(
        "before", F.when(F.col("seq") > F.col("done"), "complete").when(F.col("previous") == "processing", "processing")
        .when(F.col("seq") > F.col("first_claim"), "failed").otherwise("pending"))
    valid = (F.when(F.col("status") == "processing", F.col("before").isin("pending", "failed"))
             .when(F.col("status") == "failed", F.col("before") == "processing")
             .otherwise(F.col("before").isin("processing", "complete")))
    steps = steps.select("source_id", "seq", "status", "before", valid.alias("valid"))
    current = (events.select("source_id").distinct()
               .join(steps.filter("valid").groupBy("source_id").agg(
                   F.max_by("status", "seq").alias("status"), F.count("*").alias("n_valid")), "source_id", "left")
               .select("source_id", F.coalesce("status", F.lit("pending")).alias("status"),
                       F.coalesce("n_valid", F.lit(0)).alias("n_valid")))
    return current, steps


def remember_results(results: DataFrame, sources: DataFrame, memories: DataFrame) -> DataFrame:
    """Per call: source, duplicate flag, its observations by seq, status.

    Observation lists are built once per source (a source has at most the
    extraction cap) and then attached to the calls.
    """
    lists = (memories.filter("sealed and depth = 0").groupBy(F.col("source_ref").alias("source_id"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("memory_ids")))
    per_source = (sources.select(F.col("id").alias("source_id"), "status").join(lists, "source_id", "left")
                  .withColumn("memory_ids", F.coalesce("memory_ids", F.array().cast("array<string>"))))
    return (results.join(per_source, "source_id", "left")
            .withColumn("duplicate", ~F.col("new_source")))
