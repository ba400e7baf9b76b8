"""Work planning queries."""

from pyspark.sql import functions as F

from memstrata.plans import work
from memstrata.sources import archive

from .aggregates import DATASET, dataset
from .registry import query

ZONE = "Asia/Seoul"
WEEKLY = list(range(61, 69))


@query("dream_work_plan", "select run_id, work_key, phase, memory_id, ordinal from c_dream where run_id % 10 <> 0")
def _(c):
    done = c.runs.filter("id % 10 = 0").select(F.col("id").alias("run_id"))
    return work.dream_plan(c.memory_rows, c.recall_events, c.runs, initialised=done)


CANDIDATES = """cw as (select run_id, work_key, phase, memory_id from c_weekly
    union all select r.id, 'carry:65:' || w.work_key, 'carry', w.memory_id from c_work w, c_runs r where w.run_id = 65 and w.status <> 'complete' and r.id > 65)"""


def weekly_candidates(c):
    return work.meditation_candidates(c.memory_rows, c.relations, c.runs, c.run_work, WEEKLY)


def orders(c):
    """Reverse key order; run 66 repeats a key and run 67 misses one."""
    found = weekly_candidates(c)
    sizes = found.groupBy("run_id").agg(F.count("*").alias("n"))
    numbered = (work.number_work(found).join(sizes, "run_id")
                .withColumn("position", F.col("n") - 1 - F.col("ordinal")).drop("ordinal", "n"))
    given = numbered.filter("not (run_id = 67 and position = 0)").select("run_id", "position", "work_key")
    return given.unionByName(numbered.filter("run_id = 66 and position = 0").select("run_id", F.lit(100_000_000).alias("position"), "work_key"))


@query("meditation_work_plan", f"""
with {CANDIDATES} select run_id, work_key, phase, memory_id, row_number() over (partition by run_id order by work_key desc) - 1 ordinal from cw where run_id not in (66, 67)""")
def _(c):
    return work.meditation_plan(weekly_candidates(c), orders(c))


@query("validate_priority", f"""
with {CANDIDATES} select run_id, case when run_id = 67 then 1 else 0 end missing, 0 as unknown, case when run_id = 66 then 1 else 0 end duplicate, run_id not in (66, 67) ok from cw group by 1""")
def _(c):
    return work.validate_priority(weekly_candidates(c), orders(c))


@query("carry_plan", """
select r.id run_id, 'carry:65:' || w.work_key work_key, 'carry' phase, w.memory_id from c_work w, c_runs r where w.run_id = 65 and w.status <> 'complete' and r.id > 65""")
def _(c):
    return work.carry_work(c.run_work, c.runs, c.memories, WEEKLY)


@query("unprioritised_close", f"""
with {CANDIDATES} select run_id, work_key, row_number() over (partition by run_id order by work_key) - 1 ordinal, 'pending' status, 'budget_exhausted' run_status from cw where run_id in (65, 66)""")
def _(c):
    runs = (c.runs.withColumn("status", F.when(F.col("id").isin(65, 66, 67), "running").otherwise(F.col("status")))
            .withColumn("work_initialized", ~F.col("id").isin(65, 66)))
    held, closed = work.close_unprioritised(weekly_candidates(c), runs)
    state = closed.select(F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    return held.join(state, "run_id").select("run_id", "work_key", "ordinal", "status", "run_status")


@query("resolve_carry_status", """
select 68 charged_run_id, 'carry:65:' || work_key work_key, 65 evidence_run_id, work_key original_key, memory_id, status original_status, model original_model,
    case when status = 'complete' then 'complete' else 'pending' end resolved_status, false broken from c_work where run_id = 65""")
def _(c):
    carried = c.run_work.filter("run_id = 65").select(
        F.lit(68).cast("long").alias("run_id"), F.concat(F.lit("carry:65:"), "work_key").alias("work_key"), F.lit("carry").alias("phase"),
        "memory_id", "ordinal", F.lit("pending").alias("status"), "model", "proposal_json")
    return work.resolve_carry(c.run_work.unionByName(carried))


@query("run_get_or_create", """
select id, kind, period_start, memory_high_water from c_runs union all
select 68 + row_number() over (order by e, kind), kind, s, (select max(seq) from c_mem) from (
    select 'dream' kind, TIMESTAMP '2024-03-01' s, TIMESTAMP '2024-03-02' e union all select 'meditation', TIMESTAMP '2024-02-26', TIMESTAMP '2024-03-04')""")
def _(c):
    t = lambda x: F.lit(x).cast("timestamp")
    row = lambda kind, a, b, usd: c.runs.limit(1).select(
        F.lit(kind).alias("kind"), t(a).alias("period_start"), t(b).alias("period_end"), F.lit(usd).cast("decimal(38,12)").alias("budget_usd"))
    asked = row("dream", "2024-03-01", "2024-03-02", None)
    for more in (row("dream", "2024-03-01", "2024-03-02", None), row("dream", "2024-01-05", "2024-01-06", None),
                 row("meditation", "2024-02-26", "2024-03-04", "1"), row("meditation", "2024-03-04", "2024-03-11", None),
                 row("dream", "2024-03-03", "2024-03-03", None)):
        asked = asked.unionByName(more)
    runs, _rejected = work.get_or_create_runs(asked, c.runs, c.memories, c.relations, c.recall_events)
    return runs.select("id", "kind", "period_start", "memory_high_water")


@query("due_periods", """
with a as (select min(cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date)) anchor from c_mem),
d as (select 'dream' kind, cast(anchor + i as date) first_day, cast(anchor + i + 1 as date) end_day from a, (select unnest(range(45))::int i)
    union all select 'meditation', cast(anchor + 7 * i as date), cast(anchor + 7 * i + 7 as date) from a, (select unnest(range(6))::int i))
select 'one' corpus_id, kind, cast(first_day as varchar) first_day, row_number() over (order by end_day, kind, first_day) as position,
    timezone('UTC', timezone('Asia/Seoul', cast(first_day as timestamp))) period_start, timezone('UTC', timezone('Asia/Seoul', cast(end_day as timestamp))) period_end from d""")
def _(c):
    anchor = work.calendar_anchor(c.memories, c.sources, None, F.lit("2024-06-01").cast("date"), ZONE)
    cursors = anchor.select(F.lit("one").alias("corpus_id"), F.col("anchor").alias("next_day"), F.col("anchor").alias("next_week"),
                            F.date_add("anchor", 45).alias("today"), F.lit("1").cast("decimal(38,12)").alias("budget_usd"))
    return work.due_periods(cursors, ZONE).select("corpus_id", "kind", "first_day", "position", "period_start", "period_end")


REPLAY = f"""{DATASET}, cut as (select question_id, greatest(max(ts), TIMESTAMP '2024-01-01' + to_days(cast(any_value(item_id) % 40 as integer))) cutoff, min(ts) first_ts from ds group by 1),
mid as (select question_id, cast(cast(first_ts as date) + 1 + i as timestamp) "at" from cut, (select unnest(range(80))::int i) where cast(cast(first_ts as date) + 1 + i as timestamp) <= cutoff),
ev as (select question_id, "at", 0 c, null::bigint ordinal, 'close_day' event, null::varchar session_id from mid union all select question_id, ts, 1, ordinal, 'session', session_id from ds)"""


@query("replay_day_plan", f"""
with {REPLAY} select question_id, event, "at", session_id, row_number() over (partition by question_id order by "at", c, ordinal) as position from ev""")
def _(c):
    from memstrata.operators.evaluation import evaluation_cutoff
    q, s = dataset(c)
    plan = work.replay_day_plan(s.select("question_id", "ts", "ordinal", "session_id"), evaluation_cutoff(q, s))
    return plan.select("question_id", "event", "at", "session_id", "position")


@query("active_day_plan", """
select cast(d as varchar) "day", sum(c)::bigint observations, sum(r)::bigint recalls from (
    select cast(created_at as date) d, 1 c, 0 r from c_mem where depth = 0 union all select cast(recalled_at as date), 0, 1 from c_recalls)
where d + 1 <= DATE '2024-01-25' group by 1""")
def _(c):
    return work.active_day_plan(c.memories, c.recall_events, F.lit("2024-01-25 12:00:00").cast("timestamp"))


def status_events(c):
    """A log of status requests per source; some of them are not allowed."""
    k = F.col("first_call_id")
    steps = (F.when(k % 6 == 0, F.array(*map(F.lit, ("pending", "processing", "complete", "complete"))))
             .when(k % 6 == 1, F.array(*map(F.lit, ("pending", "processing", "failed", "processing", "complete"))))
             .when(k % 6 == 2, F.array(*map(F.lit, ("pending", "complete", "processing", "processing", "failed"))))
             .when(k % 6 == 3, F.array(*map(F.lit, ("pending", "processing", "complete", "failed", "processing"))))
             .when(k % 6 == 4, F.array(*map(F.lit, ("pending", "failed", "processing", "failed", "complete"))))
             .otherwise(F.array(F.lit("pending"))))
    return c.registered.select(F.col("id").alias("source_id"), F.posexplode(steps).alias("seq", "status"))


LIFECYCLE = """select id source_id, case first_call_id % 6 when 0 then 'complete' when 1 then 'complete' when 2 then 'failed' when 3 then 'complete' when 4 then 'failed' else 'pending' end status,
    case first_call_id % 6 when 0 then 3 when 1 then 4 when 2 then 2 when 3 then 2 when 4 then 2 else 0 end n_valid from c_reg"""


@query("source_lifecycle", LIFECYCLE)
def _(c):
    current, _steps = work.source_lifecycle(status_events(c))
    return current


@query("remember_result", """
select c.call_id, 'src_' || c.h source_id, r.first_call_id = c.call_id new_source, r.first_call_id <> c.call_id duplicate, r.status,
    coalesce((select string_agg(m.id, ',' order by m.seq) from c_mem m where m.source_ref = r.id and m.depth = 0), '') memory_ids
from c_calls c join c_reg r on r.content_hash = c.h""")
def _(c):
    _rows, results = archive.register_sources(c.calls)
    return work.remember_results(results, c.sources, c.memories).select(
        "call_id", "source_id", "new_source", "duplicate", "status", "memory_ids")
