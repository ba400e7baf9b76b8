"""Window, ordering and paging operators, and set operations."""

from decimal import Decimal

from pyspark.sql import functions as F

from memstrata.operators import accounting, audits, evaluation, proposals, snapshot
from memstrata.plans import work

from .aggregates import DATASET, dataset
from .registry import query, usd


@query("round_robin_sample", """
with r as (select query_id, question_type, row_number() over (partition by question_type order by upper(sha256(query_id)), query_id) round from c_q where query_id not in ('q1', 'q2')),
s as (select *, row_number() over (order by round, question_type) as position from r) select * from s where position <= 8""")
def _(c):
    return evaluation.round_robin_sample(c.questions.select("query_id", "question_type"), ["q1", "q2"])


@query("even_chronological_sample", f"""
with {DATASET}, n as (select question_id, count(*) filter (is_gold) g, count(*) filter (not is_gold) o, least(10 - count(*) filter (is_gold), count(*) filter (not is_gold)) k from ds group by 1),
p as (select question_id, case when k = 1 then (o - 1) // 2 else i * (o - 1) // (k - 1) end place from (select *, unnest(range(k)) i from n where k > 0)),
t as (select *, row_number() over (partition by question_id order by ts, ordinal) - 1 place from ds where not is_gold),
kept as (select question_id, session_id, ts, ordinal from ds where is_gold union all
    select question_id, session_id, ts, ordinal from t where exists (select 1 from p where p.question_id = t.question_id and p.place = t.place))
select question_id, session_id, row_number() over (partition by question_id order by ts, ordinal) as position from kept""")
def _(c):
    _q, s = dataset(c)
    given = s.filter("is_gold").select("question_id", "session_id")
    kept, _errors = evaluation.even_chronological_sample(s.select("question_id", "session_id", "ts", "ordinal", "is_gold"), gold=given)
    return kept.select("question_id", "session_id", "position")


@query("first_outcome_wins", """
select run_id, work_key, proposal_index, arg_min(outcome, ("at", activity_id)) outcome, min("at") first_at from c_results group by 1, 2, 3""")
def _(c):
    again = F.when(F.col("outcome") == "appended", "already_exists").otherwise("appended")
    first = c.relation_results.withColumn("attempt", F.col("activity_id"))
    second = first.withColumn("outcome", again).withColumn("at", F.col("at") + F.expr("interval 90 days"))
    return proposals.first_outcomes(first.unionByName(second)).select(
        "run_id", "work_key", "proposal_index", "outcome", F.col("at").alias("first_at"))


@query("budget_exposure_timeline", f"""
with log as (select run_id, id, ordinal, created_at t, 1 step, reserved_usd amount from c_api where run_id is not null
    union all select run_id, id, ordinal, completed_at, 0, actual_usd - reserved_usd from c_api where run_id is not null and completed_at is not null),
x as (select *, coalesce(sum(amount) over (partition by run_id order by t, step, ordinal rows between unbounded preceding and 1 preceding), 0) exposure from log)
select run_id, id, t as "at", {usd('amount')} reserved_usd, {usd('exposure')} exposure_before, {usd('0.25 - exposure - amount')} headroom, exposure + amount > 0.25 violates from x where step = 1""")
def _(c):
    return accounting.budget_timeline(c.api_calls, F.lit("0.25").cast("decimal(38,12)"))


GLOBAL_LOG = """log as (select run_id, id, ordinal, created_at t, 1 step, reserved_usd amount from c_api
    union all select run_id, id, ordinal, completed_at, 0, actual_usd - reserved_usd from c_api where completed_at is not null),
x as (select *, coalesce(sum(amount) over (order by t, step, ordinal rows between unbounded preceding and 1 preceding), 0) exposure from log)"""


@query("budget_exposure_global", f"""
with {GLOBAL_LOG}
select run_id, id, t as "at", {usd('amount')} reserved_usd, {usd('exposure')} exposure_before, {usd('5 - exposure - amount')} headroom, exposure + amount > 5 violates from x where step = 1""")
def _(c):
    return accounting.global_budget_timeline(c.api_calls, F.lit("5").cast("decimal(38,12)"))


@query("budget_breaches_global", f"""
with {GLOBAL_LOG}, cap as (select 0.9 * max(exposure + amount) most from x)
select run_id, id, t as "at", {usd('exposure + amount')} exposure from x, cap where step = 1 and exposure + amount > most""")
def _(c):
    # nine tenths of the highest exposure ever reached
    most = accounting.global_budget_timeline(c.api_calls, F.lit(0).cast("decimal(38,12)")).agg(
        F.max(-F.col("headroom")).alias("most")).first().most
    return accounting.global_budget_breaches(c.api_calls, F.lit(most * Decimal("0.9")).cast("decimal(38,12)"))


@query("work_ordinals", "select run_id, work_key, ordinal from c_dream")
def _(c):
    phase = F.when(F.col("phase") == "assimilation", 0).otherwise(1)
    items = (c.run_work.filter("run_id <= 60").join(c.memories.select(F.col("id").alias("memory_id"), "created_at"), "memory_id")
             .select("run_id", "work_key", "memory_id", "created_at", phase.alias("phase_no")))
    return work.work_ordinals(items).select("run_id", "work_key", "ordinal")


DEDUP = """mem as (select w.run_id, w.work_key, w.ordinal, d.parent_id memory_id from c_dream w join c_df d on d.child_id = 'mem_d1_' || (w.ordinal % 7) where phase = 'consolidation'),
k as (select run_id, work_key, ordinal, string_agg(memory_id, ',' order by memory_id) key from mem group by 1, 2, 3)"""


@query("neighbourhood_dedup", f"""
with {DEDUP} select run_id, work_key, case when row_number() over (partition by run_id, key order by ordinal, work_key) = 1 then 'run' else 'deduplicated' end status from k""")
def _(c):
    items = c.run_work.filter("run_id <= 60 and phase = 'consolidation'").select("run_id", "work_key", "ordinal")
    members = (items.withColumn("child_id", F.concat(F.lit("mem_d1_"), F.col("ordinal") % 7))
               .join(c.derived_from, "child_id").select("run_id", "work_key", F.col("parent_id").alias("memory_id")))
    return proposals.neighbourhood_dedup(members, items).select("run_id", "work_key", "status")


@query("stable_session_order", f"with {DATASET} select question_id, session_id, row_number() over (partition by question_id order by ts, ordinal) as position from ds")
def _(c):
    _q, s = dataset(c)
    return evaluation.stable_session_order(s).select("question_id", "session_id", "position")


@query("recent_relations", "select seq, memory_id, related_memory_id, kind, related_at from c_rel order by related_at desc, seq desc limit 12")
def _(c):
    return (c.relations.orderBy(F.desc("related_at"), F.desc("seq")).limit(12)
            .select("seq", "memory_id", "related_memory_id", "kind", "related_at"))


@query("memory_page", """
with t as (select count(*) total from c_mem)
select p.id, p.seq, p.preview, total, greatest(1, cast(ceil(total / 25.0) as bigint)) pages, true has_previous, 3 < greatest(1, ceil(total / 25.0)) has_next
from (select id, seq, substr(content, 1, 240) preview from c_mem order by created_at desc, seq desc limit 25 offset 50) p, t""")
def _(c):
    view = snapshot.browse(c.memories)
    page = snapshot.page_of(view.select("id", "seq", "created_at", F.substring("content", 1, 240).alias("preview")),
                            [F.desc("created_at"), F.desc("seq")], 3)
    info = snapshot.page_info(view, 3)
    return page.drop("created_at").withColumns({k: F.lit(v).cast("boolean" if isinstance(v, bool) else "long") for k, v in info.items()})


@query("run_page", "select id, kind, started_at from c_runs where id <= 65 order by started_at desc, id desc limit 25 offset 25")
def _(c):
    return snapshot.page_of(c.runs.filter("id <= 65").select("id", "kind", "started_at"), [F.desc("started_at"), F.desc("id")], 2)


@query("work_page", """
select work_key, ordinal, status, n_abstractions is not null has_proposal from c_work where run_id = 65 order by ordinal, work_key limit 25 offset 25""")
def _(c):
    rows = c.run_work.filter("run_id = 65").select("work_key", "ordinal", "status", F.col("proposal_json").isNotNull().alias("has_proposal"))
    return snapshot.page_of(rows, [F.col("ordinal"), F.col("work_key")], 2)


@query("first_examples", """
with x as (select query_id, case when not a and b then 'gain' when a and not b then 'regression' end kind from c_pair)
select kind, row_number() over (partition by kind order by query_id) n, query_id from x where kind is not null
qualify row_number() over (partition by kind order by query_id) <= 3""")
def _(c):
    from .retrieval import metrics
    return evaluation.first_examples(evaluation.paired_outcome(metrics(c)))


# ---- sets ---------------------------------------------------------------------

@query("seed_union", "select run_id, memory_id from c_seeds")
def _(c):
    return work.seed_union(c.memories, c.recall_events, c.runs.filter("kind = 'dream'")).select("run_id", "memory_id")


@query("corpus_except", "select 2 * count(*) filter (seq % 13 = 0) + count(*) filter (seq % 17 = 0 and seq % 13 <> 0) n from c_mem where depth = 0")
def _(c):
    other = (c.memories.filter("seq % 17 <> 0 or seq % 13 = 0")
             .withColumn("content", F.when(F.col("seq") % 13 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content"))))
    return audits.corpus_difference(c.memories, other)


@query("changed_plus_carry", """
select 66 run_id, 'abstract:' || memory_id work_key, 'consolidation' phase, memory_id from c_changed where run_id = 66
union all select 66, 'carry:65:' || work_key, 'carry', memory_id from c_work where run_id = 65 and status <> 'complete'""")
def _(c):
    return work.meditation_candidates(c.memories, c.relations, c.runs, c.run_work, [66]).select("run_id", "work_key", "phase", "memory_id")
