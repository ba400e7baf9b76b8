"""Snapshots, filters and predicates."""

from pyspark.sql import functions as F

from memstrata.config import EngineConfig
from memstrata.functions import scalars as S
from memstrata.operators import snapshot
from memstrata.sources import archive, vectors
from memstrata.sources.dataset import session_payload

from .registry import query

CONFIG = EngineConfig()


def run_row(c, run_id: int) -> dict:
    return c.runs.filter(F.col("id") == run_id).first().asDict()


@query("snapshot_asof", """
with r as (select * from c_runs where id = 65)
select m.id, m.depth, coalesce(p.n, 0) n_parents, coalesce(e.n, 0) n_relations, coalesce(s.n, 0) unique_source_root_count
from c_mem m join r on m.seq <= r.memory_high_water
left join (select child_id, count(*) n from c_df group by 1) p on p.child_id = m.id
left join (select x.memory_id, count(*) n from c_rel x, r, c_mem t where t.id = x.related_memory_id and t.seq <= r.memory_high_water
           and x.seq <= r.relation_high_water group by 1) e on e.memory_id = m.id
left join (select memory_id, count(*) n from c_roots group by 1) s on s.memory_id = m.id""")
def _(c):
    m, e, _recalls = snapshot.snapshot_one(c.memories, c.relations, c.recall_events, run_row(c, 65))
    records = snapshot.memory_records(m, e, c.derived_from, c.roots)
    return records.select("id", "depth", "n_parents", "n_relations", "unique_source_root_count")


@query("restore_last_recalled", """
with r as (select * from c_runs where id = 10)
select m.id, max(e.recalled_at) last_recalled_at from c_mem m join r on m.seq <= r.memory_high_water
left join c_recalls e on e.memory_id = m.id and e.seq <= r.recall_high_water group by 1""")
def _(c):
    m, _e, recalls = snapshot.snapshot_one(c.memories, c.relations, c.recall_events, run_row(c, 10))
    return snapshot.restore_last_recalled(m, recalls).select("id", "last_recalled_at")


@query("period_filter", """
select seq, memory_id, recalled_at, strftime(timezone('Asia/Seoul', timezone('UTC', recalled_at)), '%Y-%m-%d') local_day
from c_recalls where recalled_at >= TIMESTAMP '2024-01-03 06:30:00' and recalled_at < TIMESTAMP '2024-01-20 15:00:00'""")
def _(c):
    at = F.col("recalled_at")
    ts = lambda t: F.lit(t).cast("timestamp")
    return (c.recall_events.filter(S.in_period(at, ts("2024-01-03 06:30:00"), ts("2024-01-20 15:00:00")))
            .withColumn("local_day", S.local_date(at, "Asia/Seoul")))


@query("candidate_filter", "select id, seq from c_mem where depth = 1 and id <> 'mem_d1_3'")
def _(c):
    return snapshot.candidate_filter(c.memories, depth=1, exclude="mem_d1_3").select("id", "seq")


@query("browse_memories", """
select id, seq from c_mem, c_n where depth = 0 and (contains(content, 'the') or contains(id, 'the')) and seq <= n0 - 10""")
def _(c):
    return snapshot.browse(c.memories, snapshot_seq=c.sizes[0] - 10, depth=0, search="the").select("id", "seq")


@query("input_bounds", r"""
select doc_id call_id, case when regexp_full_match(text, '[\s\p{Z}]*') then 'blank'
    when length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) > 4000 then 'too_long' end reason from documents""")
def _(c):
    return snapshot.input_bounds(c.calls, "raw", CONFIG.max_raw_characters).select("call_id", "reason")


@query("memory_content_check", r"""
select id source_id, i idx, case when length(ls[i + 1]) + len(regexp_extract_all(ls[i + 1], '[\x{10000}-\x{10FFFF}]')) > 4000 then 'content_too_long'
    when first_call_id % 17 = 0 then 'blank_model' end reason
from (select *, unnest(range(len(ls))) i from (
    select *, list_filter(string_split(raw, chr(10)), lambda x: trim(x) <> '') ls from c_reg))""")
def _(c):
    lines = (c.source_texts.select("id", "first_call_id", F.posexplode(
        F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != "")).alias("idx", "line")))
    model = F.when(F.col("first_call_id") % 17 == 0, " ").otherwise("m")
    return lines.select(F.col("id").alias("source_id"), "idx",
                        snapshot.memory_content_check(F.col("line"), model, CONFIG).alias("reason"))


@query("embedding_validity", """
select memory_id, case when vec_id % 50 = 3 then 'blank_space' when vec_id % 50 = 0 then 'empty_vector' when vec_id % 50 = 1 then 'non_finite'
    when vec_id % 50 = 2 then 'zero_vector' when vec_id % 50 in (4, 5) then 'mixed_dimensions' end reason from c_emb""")
def _(c):
    kind = F.col("vec_id") % 50
    v = F.col("vector")
    broken = (F.when(kind == 0, F.slice(v, 1, 0)).when(kind == 1, F.transform(v, lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
              .when(kind == 2, F.transform(v, lambda x: x * 0)).when(kind == 4, F.slice(v, 1, 63)).otherwise(v))
    space = F.when(kind == 3, " ").when(kind.isin(4, 5), "other:64").otherwise(F.col("space"))
    frame = c.embeddings.select("memory_id", space.alias("space"), broken.cast("array<float>").alias("vector"))
    return vectors.validity(frame).select("memory_id", "reason")


@query("incomplete_sources", "select id, status, created_at from c_reg where status in ('pending', 'failed')")
def _(c):
    return archive.incomplete_sources(c.sources).select("id", "status", "created_at")


@query("memory_lookup", """
select id, seq from c_mem where id = 'mem_d2_0' or source_ref = (select min(source_ref) from c_mem)
    or origin_key = (select min(origin_key) from c_mem where depth = 2)""")
def _(c):
    first = c.memories.agg(F.min("source_ref").alias("s"), F.min(F.when(F.col("depth") == 2, F.col("origin_key"))).alias("o")).first()
    found = [snapshot.lookup(c.memories, id="mem_d2_0"), snapshot.lookup(c.memories, source=first.s),
             snapshot.lookup(c.memories, origin_key=first.o)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("id", "seq").distinct()


VISIBLE = """
v as (select a.start request_id, a.memory_id from c_anc a where starts_with(a.start, 'mem_d2_')
    union select a.start, e.related_memory_id from c_anc a join c_rel e on e.memory_id = a.memory_id
    where starts_with(a.start, 'mem_d2_') and (e.seq - 1) % 3 <> 2)"""


@query("evidence_payload", f"""
with {VISIBLE},
shown as (select v.request_id, v.memory_id, e.related_memory_id, row_number() over (partition by v.request_id, v.memory_id order by e.seq) n
    from v join c_rel e on e.memory_id = v.memory_id join v t on t.request_id = v.request_id and t.memory_id = e.related_memory_id)
select v.request_id, v.memory_id, m.depth, m.source_ref,
    coalesce((select string_agg(related_memory_id, ',' order by n) from shown s where s.request_id = v.request_id and s.memory_id = v.memory_id and n <= 2), '') outgoing,
    coalesce(r.n, 0) - coalesce((select count(*) from shown s where s.request_id = v.request_id and s.memory_id = v.memory_id and n <= 2), 0) omitted_relation_count,
    greatest(coalesce(p.n, 0) - 2, 0) omitted_parent_count
from v join c_mem m on m.id = v.memory_id
left join (select memory_id, count(*) n from c_rel group by 1) r on r.memory_id = v.memory_id
left join (select child_id, count(*) n from c_df group by 1) p on p.child_id = v.memory_id""")
def _(c):
    from memstrata.operators.graph import ancestor_closure
    starts = c.memories.filter("depth = 2").select(F.col("id").alias("start"), F.col("id").alias("memory_id"))
    region = ancestor_closure(starts, c.derived_from, 2)
    extra = (region.join(c.relations.filter((F.col("seq") - 1) % 3 != 2), "memory_id")
             .select("start", F.col("related_memory_id").alias("memory_id")))
    requests = region.unionByName(extra).distinct().withColumnRenamed("start", "request_id")
    out = snapshot.evidence_payload(requests, c.edges, c.derived_from, c.memories, cap=2)
    ids = F.coalesce(F.array_join(F.transform("outgoing", lambda x: x["related_memory_id"]), ","), F.lit(""))
    return out.select("request_id", "memory_id", "depth", "source_ref", ids.alias("outgoing"),
                      "omitted_relation_count", "omitted_parent_count")


@query("priority_payload", """
select w.run_id, w.work_key, w.memory_id, r.period_start, r.period_end, e.related_memory_id, e.kind, t.depth related_depth, t.content related_content
from c_weekly w join c_runs r on r.id = w.run_id join c_mem m on m.id = w.memory_id and m.depth >= 1
left join c_rel e on e.memory_id = w.memory_id left join c_mem t on t.id = e.related_memory_id""")
def _(c):
    from memstrata.plans import work
    items = work.changed_work(c.memory_rows, c.relations, c.runs).join(
        c.runs.select(F.col("id").alias("run_id"), "period_start", "period_end"), "run_id")
    return snapshot.priority_payload(items, c.memories, c.edges).select(
        "run_id", "work_key", "memory_id", "period_start", "period_end", "related_memory_id", "kind", "related_depth", "related_content")


@query("session_payload", """
select 's' || conv_id session_id, cast(to_json({'ordinal': conv_id % 16, 'timestamp': strftime(TIMESTAMP '2024-01-01' + to_days(cast(conv_id % 30 as integer)) + to_minutes(conv_id % 1440), '%Y-%m-%dT%H:%M:%S.%fZ'),
    'turns': list({'role': role, 'content': text} order by turn)}) as varchar) raw from conversations group by conv_id""")
def _(c):
    return c.sessions.select("session_id", session_payload(F.col("ordinal"), F.col("ts"), F.col("turns")).alias("raw"))
