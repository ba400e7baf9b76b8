"""Rules over proposal tables that Spark derives from the corpus, broken in known ways."""

from pyspark.sql import functions as F

from memstrata.config import EngineConfig
from memstrata.operators import proposals as rules
from memstrata.sources.corpus import SPACE

from .registry import query

CONFIG = EngineConfig()


def abstraction_proposals(c):
    """One or two proposals per depth-1 group; number modulo 10 decides the defect."""
    def build():
        members = (c.derived_from.filter("child_id like 'mem\\_d1\\_%'").groupBy("child_id")
                   .agg(F.array_sort(F.collect_list("parent_id")).alias("p"))
                   .withColumn("g", F.regexp_extract("child_id", r"(\d+)$", 1).cast("long")))
        k, p = F.col("g") % 10, F.col("p")
        other = F.array(F.concat(F.lit("mem_d1_"), F.col("g")))
        derived = (F.when(k == 3, F.slice(p, 1, 2)).when(k == 4, F.concat(p, F.slice(p, 1, 1)))
                   .when(k == 6, F.concat(p, F.array(F.lit("mem_missing")))).when(k == 7, F.concat(p, F.array(F.lit("mem_d2_0"))))
                   .when(k == 8, F.concat(p, other)).otherwise(p))
        allowed = (F.when(k == 5, F.slice(p, F.lit(2), F.size(p))).otherwise(F.concat(p, other, F.array(F.lit("mem_missing"), F.lit("mem_d2_0")))))
        group = members.select(
            (F.lit(45) + F.col("g") % 15).alias("run_id"), F.concat(F.lit("abstract:"), F.col("p")[0]).alias("work_key"),
            F.when(k == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("i"),
            F.when(k == 2, "  ").otherwise("insight").alias("content"), derived.alias("derived_from"), allowed.alias("allowed"))
        # three observations of one source are three parents with one root
        same = (c.memory_rows.filter("depth = 0").groupBy("source_ref").agg(F.array_sort(F.collect_list("id")).alias("p")).filter("size(p) >= 3")
                .select(F.lit(50).cast("long").alias("run_id"), F.concat(F.lit("abstract:same:"), "source_ref").alias("work_key"), F.array(F.lit(0)).alias("i"),
                        F.lit("insight").alias("content"), F.col("p").alias("derived_from"), F.col("p").alias("allowed")))
        return (group.unionByName(same).withColumn("proposal_index", F.explode("i")).drop("i"))
    return c.space.table("abstraction_proposals", build)


PROPOSED = """
grp as (select g, child_id, p from (select child_id, list_sort(list(parent_id)) p, cast(regexp_extract(child_id, '(\\d+)$', 1) as bigint) g from c_df where starts_with(child_id, 'mem_d1_') group by 1)),
prop as (select 45 + g % 15 run_id, 'abstract:' || p[1] work_key, i proposal_index, case g % 10 when 2 then 'content_blank'
        when 3 then 'parents_below_base' when 4 then 'parents_below_base'
        when 5 then 'parent_not_offered' when 6 then 'parent_unknown' when 7 then 'parent_not_before_run'
        when 8 then case when 1 + g % 30 < 45 + g % 15 and m.seq <= r.memory_high_water then 'parent_depths_differ' else 'parent_not_before_run' end end reason, p
    from grp, (select unnest(range(2)) i), c_mem m, c_runs r where (i = 0 or g % 10 = 1) and m.id = child_id and r.id = 45 + g % 15
    union all select 50, 'abstract:same:' || source_ref, 0, 'roots_below_power', list_sort(list(id)) from c_mem where depth = 0 group by source_ref having count(*) >= 3),
ver as (select run_id, work_key, proposal_index, reason, p, case when reason is null then 1 end depth,
    case when reason is null then (select count(distinct source_ref) from c_mem where list_contains(p, id)) end n_roots from prop)"""


def verdicts(c):
    return rules.validate_abstractions(abstraction_proposals(c), c.memory_rows, c.roots, c.runs, CONFIG)


@query("validate_abstractions", f"with {PROPOSED} select run_id, work_key, proposal_index, reason, depth::bigint depth, n_roots from ver")
def _(c):
    return verdicts(c).select("run_id", "work_key", "proposal_index", "reason", "depth", "n_roots")


def applied(c):
    running = c.runs.withColumn("status", F.when(F.col("id") % 5 == 0, "complete").otherwise("running"))
    return rules.apply_abstractions(verdicts(c), c.memory_rows, c.roots, running, "2024-03-01 00:00:00", "fixture-model")


APPLIED = PROPOSED + """,
ap as (select *, case when proposal_index >= 1 then 'second_of_neighbourhood' when reason is not null then reason
    when run_id % 5 = 0 then 'run_finished' end why from ver)"""


@query("apply_abstractions", f"""
with {APPLIED} select 'mem_' || substr(sha256('run:' || run_id || ':' || work_key || ':' || proposal_index), 1, 32) id, run_id dream_revision, depth::bigint depth, len(p) n_parents, n_roots
from ap where why is null""")
def _(c):
    new = applied(c)
    parents = new["derived_from"].groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("n_parents"))
    roots = new["memory_roots"].groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n_roots"))
    return new["memories"].select("id", "dream_revision", "depth").join(parents, "id").join(roots, "id")


@query("apply_embedded_abstractions", f"""
with {APPLIED}, ok as (select 'mem_' || substr(sha256('run:' || run_id || ':' || work_key || ':' || proposal_index), 1, 32) id, run_id, len(p) n_parents, n_roots from ap where why is null)
select id, case run_id % 7 when 5 then 'no vector' when 2 then 'wrong dimensions' when 3 then 'not finite' when 4 then 'zero vector' end reason,
    case when run_id % 7 not between 2 and 5 then n_parents end n_parents, case when run_id % 7 not between 2 and 5 then n_roots end n_roots,
    case when run_id % 7 not between 2 and 5 then run_id::double end first_value from ok""")
def _(c):
    new = applied(c)
    kind = F.col("dream_revision") % 7
    filled = lambda x, n=64: F.array_repeat(x.cast("float"), n)
    own = F.col("dream_revision")
    made = new["memories"].filter(kind != 5).select("id", F.when(kind == 2, filled(own, 63)).when(kind == 3, filled(F.lit("NaN")))
                                                    .when(kind == 4, filled(F.lit(0))).otherwise(filled(own)).alias("vector"))
    out = rules.with_vectors(new, made, SPACE, 64)
    parents = out["derived_from"].groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("n_parents"))
    roots = out["memory_roots"].groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n_roots"))
    firsts = out["embeddings"].select(F.col("memory_id").alias("id"), F.col("vector")[0].cast("double").alias("first_value"))
    stored = out["memories"].select("id").join(parents, "id", "left").join(roots, "id", "left").join(firsts, "id", "left")
    return stored.unionByName(out["withheld"].select("id", "reason"), allowMissingColumns=True).select(
        "id", "reason", "n_parents", "n_roots", "first_value")


@query("rejected_proposals", f"with {APPLIED} select run_id, work_key, proposal_index, why reason from ap where why is not null")
def _(c):
    return applied(c)["rejected"]


def relation_proposals(c):
    """Three proposals per relation result, some broken on purpose."""
    e = F.regexp_extract("activity_id", r"(\d+)$", 1).cast("long")
    base = c.relation_results.select("run_id", "work_key", "activity_id", e.alias("e"), "at", F.col("related_memory_id").alias("seed_id"),
                                     F.col("memory_id").alias("owner"), "kind")
    wide = base.withColumn("work_key", F.concat("work_key", F.lit("#"), "e")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("proposal_index"))
    broken = (F.col("e") % 8 == 1) & (F.col("proposal_index") == 0)
    return wide.select(
        "run_id", "work_key", "proposal_index", "at", "e", F.when(F.col("e") % 8 == 2, F.col("seed_id")).otherwise(F.col("owner")).alias("memory_id"),
        F.when(broken, F.col("owner")).otherwise(F.col("seed_id")).alias("related_memory_id"),
        F.when((F.col("e") % 8 == 3) & (F.col("proposal_index") == 1), "neutral").otherwise(
            F.when(F.col("proposal_index") == 2, F.when(F.col("kind") == "positive", "negative").otherwise("positive")).otherwise(F.col("kind"))).alias("kind"),
        "seed_id", F.when(F.col("e") % 8 == 4, F.array("seed_id")).otherwise(F.array("owner", "seed_id")).alias("allowed"))


RELATED = """
rp0 as (select run_id, work_key || '#' || event_id work_key, i proposal_index, "at", event_id e, case when event_id % 8 = 2 then related_memory_id else memory_id end memory_id, memory_id as owner,
    case when event_id % 8 = 1 and i = 0 then memory_id else related_memory_id end related_memory_id,
    case when event_id % 8 = 3 and i = 1 then 'neutral' when i = 2 then case when kind = 'positive' then 'negative' else 'positive' end else kind end kind,
    related_memory_id seed_id, event_id % 8 <> 4 or memory_id = related_memory_id offered from c_results, (select unnest(range(3)) i)),
rp as (select *, (offered or memory_id = seed_id) and related_memory_id = seed_id and memory_id <> seed_id and kind in ('positive', 'negative') sound from rp0),
rv as (select *, case when not sound or row_number() over (partition by run_id, work_key, memory_id, related_memory_id, kind, sound order by proposal_index) > 1
    then 'relation_not_sound' end reason from rp)"""


def relation_verdicts(c):
    return rules.validate_relations(relation_proposals(c), c.memories)


@query("validate_relations", f"with {RELATED} select run_id, work_key, proposal_index, memory_id, kind, reason from rv")
def _(c):
    return relation_verdicts(c).select("run_id", "work_key", "proposal_index", "memory_id", "kind", "reason")


@query("apply_relations", f"""
with {RELATED}, ck as (select v.*, case when v.reason is not null then v.reason when o.seq <= r.memory_high_water and t.seq <= r.memory_high_water and o.dream_revision < r.id and t.dream_revision < r.id then null
        else 'relation_outside_snapshot' end why
    from rv v join c_runs r on r.id = v.run_id left join c_mem o on o.id = v.memory_id left join c_mem t on t.id = v.related_memory_id),
ou as (select *, case when why is not null then 'rejected' when exists (select 1 from c_rel x where x.memory_id = ck.memory_id and x.related_memory_id = ck.related_memory_id and x.kind = ck.kind)
    or row_number() over (partition by memory_id, related_memory_id, kind, why is null order by run_id, e, proposal_index) > 1 then 'already_exists' else 'appended' end outcome from ck)
select run_id, work_key, proposal_index, outcome, why reason from ou""")
def _(c):
    # the reports name runs of the first month; later runs own the late memories
    _new, outcomes = rules.apply_relations(relation_verdicts(c).withColumn("ordinal", F.col("e")), c.memories, c.relations, c.runs)
    return outcomes.select("run_id", "work_key", "proposal_index", "outcome", "reason")


@query("validate_observations", """
with n as (select id source_id, first_call_id f, i, ls from (select *, unnest(range(len(ls))) i from (
    select *, list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> '') ls from c_reg)) )
select source_id, count(*) n, case when count(*) > 3 then 'too_many' when bool_or(length(ls[i + 1]) > 4000) then 'content' when any_value(f) % 7 = 3 then 'vector'
    when any_value(f) % 7 = 4 then 'blank_id' when any_value(f) % 7 = 5 and count(*) > 1 then 'repeated_id' end reason from n group by 1""")
def _(c):
    k = F.col("first_call_id") % 7
    lines = (c.source_texts.select("id", "first_call_id", F.posexplode(F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")).alias("position", "content")))
    obs = lines.select(
        F.col("id").alias("source_id"), "position", "content", F.lit("m").alias("model"),
        F.when(k == 4, F.lit(" ")).when(k == 5, F.lit("same")).otherwise(F.concat(F.lit("o"), "position")).alias("id"),
        F.when(k == 3, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5))).cast("array<float>").alias("vector"))
    return rules.validate_observations(obs, CONFIG)


@query("validate_evidence_labels", """
with o as (select query_id request_id, memory_id, rank from c_cand where condition = 'A'), k as (select query_id request_id, item_id from c_q),
x as (select o.request_id, count(*) n from o group by 1)
select x.request_id, case when item_id % 5 = 1 then 1 else 0 end missing, case when item_id % 5 = 2 then 1 else 0 end as unknown,
    case when item_id % 5 = 3 then 1 else 0 end repeated, case when item_id % 5 = 4 then 1 else 0 end blank_reason, 0 bad_offer, item_id % 5 = 0 ok from x join k using (request_id)""")
def _(c):
    i = F.col("item_id") % 5
    offered = (c.candidates.filter("condition = 'A'").select(F.col("query_id").alias("request_id"), "memory_id", "rank")
               .join(c.questions.select(F.col("query_id").alias("request_id"), "item_id"), "request_id"))
    labels = offered.filter(~((i == 1) & (F.col("rank") == 1))).select(
        "request_id", "memory_id", F.when((i == 4) & (F.col("rank") == 2), " ").otherwise("because").alias("reason"))
    more = offered.filter("rank = 1").filter(i.isin(2, 3)).select(
        "request_id", F.when(i == 2, F.lit("mem_unknown")).otherwise(F.col("memory_id")).alias("memory_id"), F.lit("because").alias("reason"))
    return rules.validate_evidence_labels(labels.unionByName(more), offered.select("request_id", "memory_id", F.lit(0).alias("depth")))


@query("validate_usage", f"""
select id call_id, (ordinal % 6 = 0)::bigint + (ordinal % 10 = 5)::bigint n_invalid, case when ordinal % 10 <> 5 then input_tokens when ordinal % 6 <> 0 then input_tokens + 7 end input_tokens
from c_api where input_tokens is not null""")
def _(c):
    u = F.from_json("usage_json", "input_tokens long, cached_input_tokens long, output_tokens long, cache_write_tokens long")
    base = c.api_calls.filter("usage_json is not null").withColumn("u", u)
    first = base.select(F.col("id").alias("call_id"), "ordinal", F.col("completed_at").alias("at"), F.lit(0).alias("attempt"),
                        F.when(F.col("ordinal") % 10 == 5, -1).otherwise(F.col("u.input_tokens")).alias("input_tokens"),
                        F.col("u.cached_input_tokens").alias("cached"), F.col("u.cache_write_tokens").alias("writes"),
                        F.col("u.output_tokens").alias("output"), F.col("actual_usd").alias("cost"))
    again = base.select(F.col("id").alias("call_id"), "ordinal", F.col("completed_at").alias("at"), F.lit(1).alias("attempt"),
                        (F.col("u.input_tokens") + 7).alias("input_tokens"),
                        F.when(F.col("ordinal") % 6 == 0, 10_000_000).otherwise(F.col("u.cached_input_tokens")).alias("cached"),
                        F.col("u.cache_write_tokens").alias("writes"), F.col("u.output_tokens").alias("output"), F.col("actual_usd").alias("cost"))
    return rules.validate_usage(first.unionByName(again)).select("call_id", "n_invalid", "input_tokens")


