"""Aggregations: corpus counters, cost ledgers, daily reports, evaluation summaries."""

from pyspark.sql import functions as F

from memstrata.functions import scalars as S
from memstrata.operators import accounting, evaluation
from memstrata.plans import daily_report as report
from memstrata.plans import work
from memstrata.session import durable

from .registry import query, usd
from .retrieval import GOLDMEM, MATCH, matches, metrics

ZONE = "Asia/Seoul"


@query("corpus_overview", """
select 'memories' metric, count(*) n from c_mem union all select 'sources', count(*) from c_reg
union all select 'relations', count(*) from c_rel union all select 'depth_' || depth, count(*) from c_mem group by depth""")
def _(c):
    return accounting.corpus_overview(c.memory_rows, c.sources, c.relations)


@query("unique_source_roots", "select memory_id, count(distinct source_id) unique_source_root_count from c_roots group by 1")
def _(c):
    return accounting.root_counts(c.roots)


@query("run_accounted_usd", f"""
select run_id, {usd('sum(coalesce(actual_usd, reserved_usd))')} accounted_usd from c_api where run_id is not null group by 1""")
def _(c):
    return accounting.run_accounted(c.api_calls)


@query("run_cost_split", f"""
select run_id, {usd('coalesce(sum(actual_usd), 0)')} settled_usd, {usd('coalesce(sum(reserved_usd) filter (actual_usd is null), 0)')} unsettled_reserved_usd,
    count(*) filter (actual_usd is null) unsettled_calls, {usd('sum(coalesce(actual_usd, reserved_usd))')} accounted_usd
from c_api where run_id is not null group by 1""")
def _(c):
    return accounting.run_cost_split(c.api_calls)


USAGE = f"""count(*) calls, {usd('coalesce(sum(actual_usd), 0)')} settled_usd, {usd('coalesce(sum(reserved_usd) filter (actual_usd is null), 0)')} reserved_usd,
    coalesce(sum(input_tokens) filter (actual_usd is not null), 0)::bigint input_tokens, coalesce(sum(output_tokens) filter (actual_usd is not null), 0)::bigint output_tokens"""


@query("usage_totals", f"select 'all' scope, {USAGE} from c_api union all select 'recall', {USAGE} from c_api where operation = 'recall'")
def _(c):
    both = accounting.usage_totals(c.api_calls).withColumn("scope", F.lit("all"))
    return both.unionByName(accounting.usage_totals(c.api_calls, "recall").withColumn("scope", F.lit("recall")))


@query("usage_by_operation", f"select plain_operation operation, {USAGE} from c_api group by 1")
def _(c):
    return accounting.usage_by_operation(c.api_calls)


@query("usage_subtract", f"select plain_operation operation, {USAGE} from c_api where operation = plain_operation group by 1")
def _(c):
    scoped = c.api_calls.filter(F.col("operation").contains("/"))
    return accounting.usage_subtract(accounting.usage_by_operation(c.api_calls), accounting.usage_by_operation(scoped), "operation")


@query("corpus_morphology", """
select (select count(*) from c_reg) sources, count(*) filter (depth = 0) depth0, count(*) filter (depth = 1) depth1, count(*) filter (depth >= 2) depth2_plus,
    (select count(*) from c_rel where kind = 'positive') positive_relations, (select count(*) from c_rel where kind = 'negative') negative_relations,
    (select count(*) from c_mem m join c_runs r on r.id = m.dream_revision where m.depth > 0 and r.kind = 'dream') dream_memories,
    (select count(*) from c_mem m join c_runs r on r.id = m.dream_revision where m.depth > 0 and r.kind = 'meditation') meditation_memories from c_mem""")
def _(c):
    return accounting.corpus_morphology(c.memories, c.relations, c.runs, c.sources)


@query("observations_per_source", """
select s.id source_id, count(m.id) n_observations from c_reg s left join c_mem m on m.source_ref = s.id and m.depth = 0 group by 1""")
def _(c):
    return accounting.observations_per_source(c.memories, c.sources.select(F.col("id").alias("source_id")))


@query("budget_rule", f"""
select r.id, {usd('r.budget_usd')} budget_usd, {usd('coalesce(a.x, 0)')} accounted_usd, case when r.budget_usd is null then 'no budget'
    when r.budget_usd > 5 then 'budget above the cap' when a.x > 5 then 'cost above the cap' end reason
from c_runs r left join (select run_id + 60 run_id, sum(coalesce(actual_usd, reserved_usd)) x from c_api where run_id <= 8 group by 1) a on a.run_id = r.id
where r.kind = 'meditation'""")
def _(c):
    moved = c.api_calls.filter("run_id <= 8").withColumn("run_id", F.col("run_id") + 60)
    return accounting.budget_rule(c.runs, moved)


@query("run_summary", f"""
select r.id, r.kind, r.status, coalesce(w.c, 0) completed_work, coalesce(w.n, 0) total_work, coalesce(j.n, 0) rejected_proposals,
    {usd('coalesce(a.x, 0)')} accounted_usd, coalesce(m.n, 0) output_memories
from c_runs r left join (select run_id, count(*) n, count(*) filter (status = 'complete') c from c_work group by 1) w on w.run_id = r.id
left join (select run_id, count(*) n from (select distinct run_id, work_key, proposal_index from c_results where outcome = 'rejected') group by 1) j on j.run_id = r.id
left join (select run_id, sum(coalesce(actual_usd, reserved_usd)) x from c_api group by 1) a on a.run_id = r.id
left join (select dream_revision, count(*) n from c_mem where depth > 0 group by 1) m on m.dream_revision = r.id""")
def _(c):
    rejected = c.relation_results.filter("outcome = 'rejected'").select("run_id", "work_key", "proposal_index").distinct()
    return accounting.run_summary(c.runs, c.run_work, rejected, c.api_calls, c.memory_rows)


@query("pruning_summary", """
select count(*) consolidation_work, count(*) filter (model = 'consolidation-ineligible') infeasible,
    count(*) filter (model = 'dream-neighborhood-deduplicated') deduplicated, count(*) filter (n_abstractions = 0) empty_responses,
    (select count(*) from c_api where plain_operation = 'consolidation') consolidation_calls,
    (select count(*) from c_mem m join c_runs r on r.id = m.dream_revision where r.kind = 'dream' and m.depth > 0) created_abstractions
from c_work where phase = 'consolidation' and run_id in (select id from c_runs where kind = 'dream')""")
def _(c):
    return accounting.pruning_summary(c.run_work, c.runs, c.api_calls, c.memories)


# ---- many corpora: the corpus id is taken from the rows themselves ------------

def by_corpus(df, number):
    return df.withColumn("corpus_id", F.concat(F.lit("corpus_"), number % 4))


CORPORA = """s as (select *, 'corpus_' || (first_call_id % 4) corpus_id from c_reg), m as (select *, 'corpus_' || (seq % 4) corpus_id from c_mem),
r as (select *, 'corpus_' || (id % 4) corpus_id from c_runs), a as (select *, 'corpus_' || (ordinal % 4) corpus_id from c_api),
l as (select *, 'corpus_' || (seq % 4) corpus_id from c_rel)"""


@query("execution_status", f"""
with {CORPORA}, k as (select * from (select corpus_id, count(*) filter (status = 'complete') completed_sources from s group by 1)
    join (select corpus_id, count(*) filter (depth = 0) depth0, count(*) filter (depth > 0) higher_depth from m group by 1) using (corpus_id)
    join (select corpus_id, count(*) filter (kind = 'dream' and status = 'complete') completed_dreams,
          count(*) filter (kind = 'meditation' and status in ('complete', 'budget_exhausted')) finished_meditations from r group by 1) using (corpus_id)
    join (select corpus_id, {USAGE} from a group by 1) using (corpus_id))
select corpus_id, sum(completed_sources)::bigint completed_sources, sum(depth0)::bigint depth0, sum(higher_depth)::bigint higher_depth,
    sum(completed_dreams)::bigint completed_dreams, sum(finished_meditations)::bigint finished_meditations, sum(calls)::bigint calls,
    round(sum(settled_usd), 9) settled_usd, round(sum(reserved_usd), 9) reserved_usd, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens
from k group by rollup (corpus_id)""")
def _(c):
    return accounting.execution_status(
        by_corpus(c.registered, F.col("first_call_id")), by_corpus(c.memories, F.col("seq")),
        by_corpus(c.runs, F.col("id")), by_corpus(c.api_calls, F.col("ordinal")))


@query("stopped_run_rollup", f"""
with {CORPORA}, z as (select corpus_id, 'sources' section, status key, count(*) n from s group by all union all select corpus_id, 'memories', depth::varchar, count(*) from m group by all
    union all select corpus_id, 'relations', kind, count(*) from l group by all union all select corpus_id, 'runs', kind || '/' || status, count(*) from r group by all
    union all select m.corpus_id, 'outputs', r.kind, count(*) from m join r on r.id = m.dream_revision and r.corpus_id = m.corpus_id where m.depth > 0 group by all)
select *, 0.0::double settled_usd, 0.0::double reserved_usd from z
union all select corpus_id, 'calls', operation, count(*), {usd('coalesce(sum(actual_usd), 0)')}, {usd('coalesce(sum(reserved_usd) filter (actual_usd is null), 0)')}
from a group by grouping sets ((operation, corpus_id), (operation))""")
def _(c):
    return accounting.stopped_run_rollup(
        by_corpus(c.registered, F.col("first_call_id")), by_corpus(c.memories, F.col("seq")), by_corpus(c.relations, F.col("seq")),
        by_corpus(c.runs, F.col("id")), by_corpus(c.api_calls, F.col("ordinal")))


# ---- daily report ------------------------------------------------------------

def source_details(c):
    known = F.col("call_id") % 9 != 0
    # lengths are taken where the texts are read: the texts do not travel
    sizes = c.calls.select(F.col("call_id").alias("first_call_id"), F.when(known, S.utf16_length(F.col("raw"))).alias("raw_characters"),
                           F.when(known, S.utf8_length(F.col("raw"))).alias("raw_bytes"))
    return c.space.table("source_details", lambda: c.registered.join(sizes, "first_call_id").select(
        "id", "created_at", "status", "raw_characters", "raw_bytes"))


def attributed(c):
    return report.attribute_calls(c.api_calls, c.api_links, c.operations)


def linked_operations(c):
    return c.space.table("linked_operations", lambda: report.day_operations(c.operations, report.linked_calls(c.api_calls, c.api_links), ZONE))


def day_runs(c):
    return c.space.table("day_runs", lambda: report.report_runs(c.operations, linked_operations(c), c.api_calls, c.runs, ZONE))


REMEMBER = """
a as (select date, count(*) filter (kind = 'remember' and origin = 'agent') observed_calls,
        coalesce(sum(raw_characters) filter (kind = 'remember' and origin = 'agent'), 0)::bigint submitted_raw_characters,
        coalesce(sum(raw_bytes) filter (kind = 'remember' and origin = 'agent'), 0)::bigint submitted_raw_bytes,
        count(*) filter (kind = 'remember' and origin = 'agent' and raw_bytes is null) unknown_raw_size_calls,
        count(*) filter (kind = 'remember' and origin = 'agent' and new_source) new_source_calls,
        count(*) filter (kind = 'remember' and origin = 'agent' and not new_source and source_id is not null) reused_source_calls,
        count(*) filter (kind = 'extraction') extraction_attempts,
        count(*) filter (kind = 'extraction' and status = 'complete' and n_created = 0) zero_observation_extractions,
        count(*) filter (kind = 'extraction' and origin = 'recovery') recovery_extraction_attempts from c_opsd where kind in ('remember', 'extraction') group by 1),
told as (select * from c_opsd where kind = 'remember' and origin = 'agent'),
cohort as (select date, (select count(*) from c_mem where depth = 0 and source_ref = c_srcd.id) n from c_srcd),
rs as (select date, string_agg(status || ':' || n, ',' order by status || ':' || n) states from (select date, status, count(*) n from told group by 1, 2) group by 1),
es as (select date, string_agg(status || ':' || n, ',' order by status || ':' || n) extraction_states from (select date, status, count(*) n from c_opsd where kind = 'extraction' group by 1, 2) group by 1),
ns as (select date, string_agg(status || ':' || n, ',' order by status || ':' || n) new_source_current_states from (select date, status, count(*) n from c_srcd group by 1, 2) group by 1),
rd as (select date, count(raw_characters) raw_characters_n, quantile_disc(raw_characters, 0.5)::bigint raw_characters_p50, quantile_disc(raw_characters, 0.9)::bigint raw_characters_p90, max(raw_characters)::bigint raw_characters_max from told where raw_characters is not null group by 1),
rb as (select date, count(raw_bytes) raw_bytes_n, quantile_disc(raw_bytes, 0.5)::bigint raw_bytes_p50, quantile_disc(raw_bytes, 0.9)::bigint raw_bytes_p90, max(raw_bytes)::bigint raw_bytes_max from told where raw_bytes is not null group by 1),
cd as (select date, count(*) created_d0_per_new_source_n, quantile_disc(n, 0.5)::bigint created_d0_per_new_source_p50, quantile_disc(n, 0.9)::bigint created_d0_per_new_source_p90, max(n)::bigint created_d0_per_new_source_max from cohort group by 1),
s as (select date, count(*) new_unique_sources, coalesce(sum(raw_bytes), 0)::bigint new_stored_raw_bytes_known,
        coalesce(sum(raw_characters), 0)::bigint new_stored_raw_characters_known, count(*) filter (raw_bytes is null) new_source_size_unknown from c_srcd group by 1),
m as (select cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date) date, count(*) created_d0 from c_mem where depth = 0 group by 1)"""


REMEMBERED = """select cast(date as varchar) date, coalesce(columns(lambda x: x similar to '.*(calls|submitted_raw.*|attempts|extractions|sources|_known|_unknown|created_d0|_n)'), 0),
    coalesce(columns(lambda x: x similar to '.*states'), ''), columns(lambda x: x similar to '.*(_p50|_p90|_max)')
from a full join s using (date) full join m using (date) full join rs using (date) full join es using (date) full join ns using (date)
    full join rd using (date) full join rb using (date) full join cd using (date)"""


@query("daily_remember_summary", f"""
with {REMEMBER} {REMEMBERED}""")
def _(c):
    return report.remember_summary(c.activity, source_details(c), c.memory_rows, ZONE)


RETURNED = """
ret as (select o.date, r.id memory_id, coalesce(m.depth::varchar, 'unknown') depth, count(*) n from c_opsd o join c_reflist r on r.event_id = o.event_id and r.role = 'returned'
    left join c_mem m on m.id = r.id group by 1, 2, 3)"""


RECALLED = """select cast(o.date as varchar) date, count(*) observed_calls, count(*) filter (status = 'complete' and n_returned = 0) empty_completed_results,
    count(*) filter (status = 'complete' and n_candidates = 0) zero_candidate_completed_calls,
    count(*) filter (status = 'complete' and n_candidates > 0 and n_returned = 0) candidates_but_zero_returned,
    coalesce(any_value(r.t), 0)::bigint returned_d0_total, coalesce(any_value(r.d), 0)::bigint returned_d0_distinct,
    coalesce(any_value(b.returned_by_depth), '') returned_by_depth, any_value(z.states) states
from c_opsd o left join (select date, string_agg(depth || ':' || n, ',' order by depth || ':' || n) returned_by_depth from (select date, depth, sum(n)::bigint n from ret group by 1, 2) group by 1) b on b.date = o.date
left join (select date, string_agg(status || ':' || n, ',' order by status || ':' || n) states from (select date, status, count(*) n from c_opsd where kind = 'recall' group by 1, 2) group by 1) z on z.date = o.date
left join (select date, sum(n) t, count(*) d from ret where depth = '0' group by 1) r on r.date = o.date where kind = 'recall' group by o.date"""


@query("daily_recall_summary", f"""with {RETURNED} {RECALLED}""")
def _(c):
    return report.recall_summary(c.activity, c.memory_rows, ZONE)


@query("returned_frequency", f"with {RETURNED} select cast(date as varchar) date, memory_id, depth, n from ret")
def _(c):
    return report.returned_memories(c.activity, c.memory_rows, ZONE)


ASSIM = """
a as (select date, count(*) attempts, count(*) filter (model_invoked) model_invoked_attempts, count(*) filter (proposal_reused) proposal_reused_attempts,
        count(*) filter (status = 'complete' and n_relations = 0) completed_zero_proposal_attempts, count(distinct (run_id, work_key)) logical_work_count
      from c_opsd where kind = 'assimilation' group by 1),
k as (select date, count(*) linked_api_reservations from c_attr where parent_kind = 'assimilation' group by 1),
att as (select distinct run_id, work_key from c_ops where kind = 'assimilation'),
w as (select d.date, count(*) filter (att.run_id is null) referenced_run_work_without_recorded_attempt_as_of from c_dayruns d join c_work w on w.run_id = d.run_id and w.phase = 'assimilation'
        left join att on att.run_id = w.run_id and att.work_key = w.work_key group by 1),
x as (select cast(timezone('Asia/Seoul', timezone('UTC', "at")) as date) date, count(*) relation_results_at_execution_date from c_results group by 1),
ws as (select date, string_agg(status || ':' || n, ',' order by status || ':' || n) referenced_run_work_states_as_of from (
    select d.date, w.status, count(*) n from c_dayruns d join c_work w on w.run_id = d.run_id and w.phase = 'assimilation' group by 1, 2) group by 1),
st as (select date, string_agg(status || ':' || n, ',' order by status || ':' || n) states from (select date, status, count(*) n from c_opsd where kind = 'assimilation' group by 1, 2) group by 1),
rx as (select r.*, cast(timezone('Asia/Seoul', timezone('UTC', "at")) as date) date, case when o.id is null or t.id is null then 'unknown' when o.depth > 0 and t.depth = 0 then 'abstraction_to_d0'
    when o.depth = 0 and t.depth = 0 then case when o.source_ref = t.source_ref then 'same_source_d0' else 'cross_source_d0' end else 'other_depths' end category
    from c_results r left join c_mem o on o.id = r.memory_id left join c_mem t on t.id = r.related_memory_id),
oc as (select date, string_agg(outcome || ':' || n, ',' order by outcome || ':' || n) outcomes from (select date, outcome, count(*) n from rx group by 1, 2) group by 1),
ac as (select date, string_agg(category || ':' || n, ',' order by category || ':' || n) appended_categories from (select date, category, count(*) n from rx where outcome = 'appended' group by 1, 2) group by 1)"""

ASSIMILATED = """select cast(date as varchar) date, coalesce(columns(* exclude (date, states, outcomes, appended_categories, referenced_run_work_states_as_of)), 0),
    coalesce(states, '') states, coalesce(outcomes, '') outcomes, coalesce(appended_categories, '') appended_categories, coalesce(referenced_run_work_states_as_of, '') referenced_run_work_states_as_of
from a full join k using (date) full join w using (date) full join x using (date) full join ws using (date) full join st using (date) full join oc using (date) full join ac using (date)"""


@query("daily_assimilation_summary", f"""
with {ASSIM} {ASSIMILATED}""")
def _(c):
    return report.assimilation_summary(c.activity, attributed(c), c.run_work, day_runs(c), c.relation_results, c.memory_rows, ZONE)


COST = f"""
k as (select date, count(*) api_calls, coalesce(sum(actual_usd), 0) actual_usd, coalesce(sum(reserved_usd) filter (actual_usd is null), 0) unsettled_reserved_usd,
        count(*) filter (actual_usd is null) unsettled_calls, count(*) filter (activity_id is null) unattributed_calls,
        coalesce(sum(actual_usd) filter (activity_id is null), 0) unattributed_actual_usd,
        coalesce(sum(actual_usd) filter (parent_kind = 'assimilation'), 0) assimilation_actual_usd from c_attr group by 1),
s as (select date, count(*) new_sources from c_srcd group by 1),
w as (select date, count(distinct (run_id, work_key)) works from c_opsd where kind = 'assimilation' group by 1)"""


COSTS = f"""select cast(date as varchar) date, api_calls, {usd('actual_usd')} actual_usd, {usd('unsettled_reserved_usd')} unsettled_reserved_usd, unsettled_calls, unattributed_calls,
    {usd('unattributed_actual_usd')} unattributed_actual_usd, {usd('assimilation_actual_usd')} assimilation_actual_usd, coalesce(new_sources, 0) new_sources, coalesce(works, 0) works,
    case when coalesce(new_sources, 0) > 0 then round(cast(actual_usd as double) / new_sources, 9) end actual_usd_per_new_source,
    case when coalesce(works, 0) > 0 then round(cast(assimilation_actual_usd as double) / works, 9) end actual_usd_per_assimilation_work
from k left join s using (date) left join w using (date)"""


@query("daily_cost_summary", f"""with {COST} {COSTS}""")
def _(c):
    return report.cost_summary(attributed(c), c.operations, source_details(c), ZONE)


BEFORE = "date < '2024-01-10'"
KNOWN_BEFORE = "date|observed_calls|new_unique_sources|new_stored_.*|new_source_size_unknown|created_d0.*|new_source_current_states"
REPORT = f"""
re as (with {REMEMBER} {REMEMBERED}), rc as (with {RETURNED} {RECALLED}), am as (with {ASSIM} {ASSIMILATED}), ct as (with {COST} {COSTS}),
dd as (select date from re union select date from rc union select date from am union select date from ct),
re1 as (select date, columns(lambda x: x similar to '{KNOWN_BEFORE}' and x <> 'date'), case when not {BEFORE} then columns(lambda x: not x similar to '{KNOWN_BEFORE}') end from re),
rc1 as (select date, observed_calls, case when not {BEFORE} then columns(* exclude (date, observed_calls)) end from rc),
am1 as (select date, case when not {BEFORE} then columns(* exclude (date)) end from am),
rep as (select dd.date, case when {BEFORE} then 'unknown_legacy' when dd.date = '2024-01-10' then 'partial_from_instrumentation_start' else 'instrumented' end coverage,
        dd.date >= '2024-01-28' provisional, a.* exclude (date), b.* exclude (date), c.* exclude (date), d.* exclude (date) from dd
    left join (select date, columns('^(?:[^d]|d[^a]|da[^t]|dat[^e]).*$') as 'remember_\\0' from re1) a using (date)
    left join (select date, columns('^(?:[^d]|d[^a]|da[^t]|dat[^e]).*$') as 'recall_\\0' from rc1) b using (date)
    left join (select date, columns('^(?:[^d]|d[^a]|da[^t]|dat[^e]).*$') as 'assimilation_\\0' from am1) c using (date)
    left join (select date, columns('^(?:[^d]|d[^a]|da[^t]|dat[^e]).*$') as 'costs_\\0' from ct) d using (date))""".replace("{BEFORE}", BEFORE).replace("case when date <", "case when dd.date <")


def whole_report(c, calls=None):
    # two sections read the attributed calls
    joined = durable(report.attribute_calls(c.api_calls if calls is None else calls, c.api_links, c.operations).select(*report.ATTRIBUTED))
    day = lambda t: F.lit(t).cast("date")
    return report.daily_report(c.activity, source_details(c), c.memory_rows, joined, c.run_work, day_runs(c), c.relation_results, ZONE,
                               day("2024-01-10"), day("2024-01-28"))


def stored_report(c):
    return c.space.table("daily_report", lambda: whole_report(c))


@query("daily_report", f"with {REPORT} select * from rep")
def _(c):
    return stored_report(c)


@query("daily_stage_costs", f"""
select cast(date as varchar) date, coalesce(parent_kind, 'unattributed') parent, operation, count(*) api_calls, {usd('coalesce(sum(actual_usd), 0)')} actual_usd,
    {usd('coalesce(sum(reserved_usd) filter (actual_usd is null), 0)')} unsettled_reserved_usd, coalesce(sum(input_tokens), 0)::bigint input_tokens,
    coalesce(sum(cached_tokens), 0)::bigint cached_input_tokens, coalesce(sum(write_tokens), 0)::bigint cache_write_tokens,
    coalesce(sum(output_tokens), 0)::bigint output_tokens, count(*) filter (input_tokens is null) usage_unknown_calls from c_attr group by all""")
def _(c):
    return report.stage_costs(attributed(c), ZONE)


@query("nearest_rank_distribution", """
select cast(date as varchar) date, count(raw_bytes) n, quantile_disc(raw_bytes, 0.5)::bigint p50, quantile_disc(raw_bytes, 0.9)::bigint p90, max(raw_bytes)::bigint max
from c_srcd where raw_bytes is not null group by 1""")
def _(c):
    return report.nearest_rank(report.on_date(source_details(c), "created_at", ZONE), ["date"], "raw_bytes")


@query("frequency_map", """
select cast(date as varchar) date, kind, string_agg(status || '=' || n, ',' order by status) counts from (
    select date, kind, status, count(*) n from c_opsd group by all) group by 1, 2""")
def _(c):
    ops = report.on_date(c.operations, "started_at", ZONE)
    return report.frequency_map(ops, ["date", "kind"], "status").select(
        "date", "kind", F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("counts"))


@query("coverage_status", f"""
with {REMEMBER}, b as (select date, coalesce(columns(* exclude (date)), 0) from a full join s using (date) full join m using (date)),
v as (select *, case when date < DATE '2024-01-10' then 'unknown_legacy' when date = DATE '2024-01-10' then 'partial_from_instrumentation_start' else 'instrumented' end coverage from b)
select cast(date as varchar) date, coverage, date >= DATE '2024-01-28' provisional, observed_calls, created_d0, new_unique_sources,
    case when coverage <> 'unknown_legacy' then submitted_raw_bytes end submitted_raw_bytes, case when coverage <> 'unknown_legacy' then extraction_attempts end extraction_attempts from v""")
def _(c):
    summary = report.remember_summary(c.activity, source_details(c), c.memory_rows, ZONE)
    day = lambda t: F.lit(t).cast("date")
    return report.mask_legacy(report.coverage_status(summary, day("2024-01-10"), day("2024-01-28")), "remember").select(
        "date", "coverage", "provisional", "observed_calls", "created_d0", "new_unique_sources", "submitted_raw_bytes", "extraction_attempts")


# ---- evaluation -----------------------------------------------------------------

COSTED = """
k as (select *, cast(item_id % 7 + 1 as decimal(10, 0)) * 0.001 shared_usd, cast(item_id % 2 as decimal(10, 0)) * 0.001 shared_reserved,
    cast(case when condition = 'B' then item_id % 5 + 2 else item_id % 4 + 1 end as decimal(10, 0)) * 0.001 condition_usd,
    cast(case when condition = 'B' then item_id % 3 else 0 end as decimal(10, 0)) * 0.001 condition_reserved,
    100 + item_id + case when condition = 'B' then 10 else 0 end recall_tokens, 10 sources, 40 + item_id % 5 depth0, (condition = 'B')::int b from c_flags)"""


@query("benchmark_condition_summary", f"""
with {COSTED} select condition, count(*) questions, count(*) filter (hit) hits, round(count(*) filter (hit) / count(*)::double, 9) recall_at_5,
    count(*) filter (correct) correct_answers, round(count(*) filter (correct) / count(*)::double, 9) accuracy,
    {usd('sum(shared_usd + condition_usd)')} attributed_usd, {usd('sum(shared_reserved + condition_reserved)')} reserved_usd, {usd('sum(condition_usd)')} condition_usd,
    sum(recall_tokens)::bigint recall_tokens, round(sum(recall_tokens) / count(*)::double, 9) mean_recall_tokens,
    count(*) filter (candidate_failure) candidate_failures, count(*) filter (selection_failure) selection_failures, count(*) filter (answer_failure) answer_failures,
    sum(sources)::bigint sources, sum(depth0)::bigint depth0, sum(b * (item_id % 4))::bigint depth1, sum(b * (item_id % 2))::bigint depth2_plus,
    sum(b * (item_id % 9))::bigint positive_relations, sum(b * (item_id % 3))::bigint negative_relations, sum(b * (item_id % 4))::bigint dream_memories,
    sum(b * (item_id % 2))::bigint meditation_memories, round(sum(depth0) / sum(sources)::double, 9) depth0_per_source from k group by 1""")
def _(c):
    return evaluation.condition_summary(metrics(c))


@query("benchmark_summary", f"""
with {COSTED}, p as (select query_id, bool_or(hit) filter (condition = 'A') a, bool_or(hit) filter (condition = 'B') b, max(shared_usd) shared_usd,
    max(shared_reserved) shared_reserved, sum(condition_usd) cu, sum(condition_reserved) cr from k group by 1)
select count(*) completed_questions, count(*) filter (query_id not in (select query_id from c_gold)) no_gold, count(*) filter (contains(query_id, '_abs')) abstentions,
    count(*) filter (not a and b) gains, count(*) filter (a and not b) regressions, {usd('sum(shared_usd)')} shared_usd, {usd('sum(shared_usd + cu)')} actual_usd,
    {usd('sum(shared_reserved + cr)')} reserved_usd, 500 expected_questions, count(*) = 500 complete,
    round(100 * (count(*) filter (b) - count(*) filter (a)) / count(*)::double, 9) difference_pp,
    case when count(*) = 500 then 100 * (count(*) filter (b) - count(*) filter (a)) >= 3 * count(*) end meets_threshold from p""")
def _(c):
    return evaluation.benchmark_summary(metrics(c), c.gold, 500)


@query("category_metrics", """
select question_type, count(distinct query_id) questions, round(count(*) filter (condition = 'A' and hit) / count(distinct query_id)::double, 9) first_recall,
    round(count(*) filter (condition = 'B' and hit) / count(distinct query_id)::double, 9) second_recall,
    round(100 * (count(*) filter (condition = 'B' and hit) - count(*) filter (condition = 'A' and hit)) / count(distinct query_id)::double, 9) difference_pp,
    100 * (count(*) filter (condition = 'B' and hit) - count(*) filter (condition = 'A' and hit)) <= -5 * count(distinct query_id) investigate
from c_flags group by 1""")
def _(c):
    return evaluation.category_metrics(metrics(c))


@query("paired_outcome", "select query_id, a first_hit, b second_hit, not a and b gain, a and not b regression from c_pair")
def _(c):
    return evaluation.paired_outcome(metrics(c))


@query("micro_verdict", f"""
with {GOLDMEM}, {MATCH}, ab as (select distinct query_id from mt join c_mem m on m.id = mt.memory_id where m.depth > 0 and rank <= 5 and len(ids) > 0),
x as (select count(*) completed, count(*) filter (not a and b) wins, count(*) filter (a and not b) losses, count(*) filter (a and b) tie_success,
    count(*) filter (not a and not b) tie_failure, count(*) filter (not a and b and query_id in (select query_id from ab)) abstraction_wins from c_pair)
select *, case when completed <> (select count(*) from c_q) then 'INCONCLUSIVE' when losses > wins then 'REGRESSION' when wins > losses and abstraction_wins > 0 then 'PROMISING' else 'INCONCLUSIVE' end verdict from x""")
def _(c):
    top = (c.candidates.filter("condition = 'B' and rank <= 5").join(matches(c), ["query_id", "memory_id"])
           .join(c.memories.select(F.col("id").alias("memory_id"), "depth"), "memory_id"))
    return evaluation.micro_verdict(metrics(c), top, c.questions.count())


@query("calendar_anchor", """
select cast(least((select min(cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date)) from c_mem),
    (select min(cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date)) from c_reg where status in ('pending', 'failed')), DATE '2024-06-01') as varchar) anchor""")
def _(c):
    return work.calendar_anchor(c.memories, c.sources, None, F.lit("2024-06-01").cast("date"), ZONE)


def dataset(c):
    """(questions, sessions) of the session dataset."""
    from memstrata.sources.corpus import after_start
    from memstrata.sources.dataset import session_payload
    ids = c.questions.select("item_id", F.col("query_id").alias("question_id"), "question_type")
    s = c.sessions.join(ids, "item_id").withColumn("raw", session_payload(F.col("ordinal"), F.col("ts"), F.col("turns")))
    q = ids.join(c.sessions.select("item_id").distinct(), "item_id", "left_semi").withColumn(
        "question_ts", after_start(F.col("item_id") % 40))
    return q, s


DATASET = """ds as (select q.query_id question_id, v.* from c_conv v join c_q q on q.item_id = v.item_id)"""


@query("evaluation_cutoff", f"""
with {DATASET} select question_id, greatest(max(ts), TIMESTAMP '2024-01-01' + to_days(cast(any_value(item_id) % 40 as integer))) cutoff from ds group by 1""")
def _(c):
    q, s = dataset(c)
    return evaluation.evaluation_cutoff(q, s)


@query("dataset_profile", f"""
with {DATASET}, raw as (select 's' || conv_id session_id, cast(to_json({{'ordinal': conv_id % 16, 'timestamp': strftime(TIMESTAMP '2024-01-01' + to_days(cast(conv_id % 30 as integer)) + to_minutes(conv_id % 1440), '%Y-%m-%dT%H:%M:%S.%fZ'),
    'turns': list({{'role': role, 'content': text}} order by turn)}}) as varchar) raw from conversations group by conv_id)
select (select count(distinct question_id) from ds) questions, count(*) sessions, max(length(raw))::bigint max_raw_utf16 from ds join raw using (session_id)""")
def _(c):
    q, s = dataset(c)
    return evaluation.dataset_profile(q, s)


