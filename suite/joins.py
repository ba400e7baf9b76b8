"""Logical joins of the corpus model."""

from pyspark.sql import functions as F

from memstrata.operators import accounting, audits, evaluation, neighbourhoods, retrieval, snapshot
from memstrata.plans import daily_report

from memstrata.plans import work

from .registry import query

ZONE = "Asia/Seoul"


@query("relation_owner_target_join", "select seq, memory_id, related_memory_id, kind, owner_depth, target_depth from c_edges")
def _(c):
    return c.edges.select("seq", "memory_id", "related_memory_id", "kind", "owner_depth", "target_depth")


@query("parent_child_join", "select child_id, string_agg(parent_id, ',' order by parent_id) parents from c_df group by 1")
def _(c):
    return snapshot.parent_lists(c.derived_from, c.memories)


@query("lexical_hit_join", "select query_id, memory_id, score from c_bm, c_n where depth = 0 and seq <= n0 - 20")
def _(c):
    scores = retrieval.bm25_scores(c.questions, c.postings, c.collection, c.memory_texts, shards=c.shards,
                                   depth=0, high_water=c.sizes[0] - 20)
    return scores.select("query_id", "memory_id", "score")


@query("call_activity_attribution", "select id, activity_id, parent_kind, parent_work_key, parent_run_id from c_attr")
def _(c):
    return daily_report.attribute_calls(c.api_calls, c.api_links, c.operations).select(
        "id", "activity_id", "parent_kind", "parent_work_key", "parent_run_id")


@query("memory_run_kind_join", """
select m.id, m.dream_revision, r.kind run_kind from c_mem m join c_runs r on r.id = m.dream_revision where m.depth > 0""")
def _(c):
    return accounting.memory_run_kind(c.memories, c.runs).select("id", "dream_revision", "run_kind")


@query("allowed_set_semi_join", """
select l.query_id, l.memory_id, row_number() over (partition by l.query_id order by l.rank) rank
from c_lexb l join c_mem m on m.id = l.memory_id where m.depth = 0""")
def _(c):
    ranked = retrieval.bm25_search(c.questions, c.postings, c.collection, c.memory_texts, 30, shards=c.shards)
    return retrieval.keep_allowed(ranked, c.memory_ids.filter("depth = 0")).select("query_id", "memory_id", "rank")


@query("missing_work_anti_join", """
select run_id, work_key, memory_id from c_work w where phase = 'assimilation'
    and not exists (select 1 from c_ops o where o.kind = 'assimilation' and o.run_id = w.run_id and o.work_key = w.work_key)""")
def _(c):
    return daily_report.unattempted_work(c.run_work, c.operations).select("run_id", "work_key", "memory_id")


NEAREST = """
near as (select h.run_id, h.memory_id seed_id, e.memory_id, row_number() over (partition by h.run_id, h.memory_id order by n.score desc, e.memory_id) rank
    from c_hseed h join c_emb s on s.memory_id = h.memory_id join c_vnear n on n.run_id = h.run_id and n.depth = s.depth and n.a = s.vec_id
    join c_emb e on e.vec_id = n.b and e.depth = s.depth and e.memory_id <> s.memory_id and e.seq <= h.memory_high_water qualify rank <= 20)"""


def run_views(c):
    """(run_id, kind, memory_high_water, relation_high_water): what each run sees."""
    return c.runs.select(F.col("id").alias("run_id"), "kind", "memory_high_water", "relation_high_water")


def run_seeds(c):
    """What each daily and weekly run looks around: new and recalled memories, changed abstractions."""
    def build():
        daily = work.seed_union(c.memory_rows, c.recall_events, c.runs.filter("kind = 'dream'")).select("run_id", "memory_id")
        weekly = work.changed_memories(c.memory_rows, c.relations, c.runs.filter("kind = 'meditation'")).select("run_id", "memory_id")
        return daily.unionByName(weekly).distinct().join(run_views(c), "run_id")
    return c.space.table("run_seeds", build)


def queries_in_views(c, seeds, own: bool):
    """The seeds' vectors as queries of their run's view; ``own``: the seed itself is left out."""
    self_id = F.col("memory_id") if own else F.lit(None).cast("string")
    return (c.embeddings.select("memory_id", "vector", "depth").join(seeds.select("run_id", "memory_id", "memory_high_water"), "memory_id")
            .select("run_id", F.col("memory_id").alias("query_id"), self_id.alias("self_id"), "vector", "depth", F.col("memory_high_water").alias("high_water")))


def nearest_same_depth(c):
    """Per run and seed, in the run's view; the levels of the abstraction are searched one after the other."""
    def build():
        queries, out = queries_in_views(c, run_seeds(c), True), None
        for depth in (0, 1, 2):
            at = F.col("depth") == depth
            part = retrieval.nearest_in_views(queries.filter(at), c.embeddings.filter(at), 20)
            out = part if out is None else out.unionByName(part)
        return out
    return c.space.table("nearest", build)


@query("nearest_neighbour_join", f"with {NEAREST} select run_id, seed_id, memory_id, rank from near")
def _(c):
    return nearest_same_depth(c).select("run_id", F.col("query_id").alias("seed_id"), "memory_id", "rank")


@query("source_session_map", """
select 'src_' || sha256(text) source_id, 'd' || doc_id session_id, count(*) over (partition by sha256(text)) > 1 repeated from documents""")
def _(c):
    ids, repeated = evaluation.source_session_map(c.calls.select("raw", F.concat(F.lit("d"), "call_id").alias("session_id")))
    return ids.join(repeated, "source_id", "left").select("source_id", "session_id", F.col("n").isNotNull().alias("repeated"))


@query("relation_category", """
select r.activity_id, case when o.depth > 0 and t.depth = 0 then 'abstraction_to_d0'
    when o.depth = 0 and t.depth = 0 then case when o.source_ref = t.source_ref then 'same_source_d0' else 'cross_source_d0' end else 'other_depths' end category
from c_results r join c_mem o on o.id = r.memory_id join c_mem t on t.id = r.related_memory_id""")
def _(c):
    return daily_report.relation_category(c.relation_results, c.memory_rows).select("activity_id", "category")


@query("source_cohort_join", """
select s.id source_id, count(m.id) n_observations from c_reg s left join c_mem m on m.source_ref = s.id and m.depth = 0 group by 1""")
def _(c):
    return daily_report.source_cohort(c.sources, c.memories).select("source_id", "n_observations")


@query("related_evidence_join", """
select e.memory_id, e.related_memory_id, row_number() over (partition by e.memory_id order by e.first_seq) as position, m.depth related_depth, m.content
from (select memory_id, related_memory_id, min(seq) first_seq from c_edges group by 1, 2) e join c_mem m on m.id = e.related_memory_id""")
def _(c):
    return neighbourhoods.related_evidence(c.edges, c.memories).select(
        "memory_id", "related_memory_id", "position", "related_depth", "content")


@query("shared_corpus_verify", """
select id memory_id, 'only in first' problem from c_mem where depth = 0 and seq % 50 = 1
union all select id, 'different memory' from c_mem where depth = 0 and seq % 50 = 2
union all select m.id, 'different vector' from c_mem m join c_emb e on e.memory_id = m.id where m.depth = 0 and m.seq % 50 = 3
union all select id, 'unmapped source' from c_mem where depth = 0 and source_ref in (select id from c_reg where first_call_id % 31 = 0)""")
def _(c):
    kind = F.col("seq") % 50
    second = c.memories.filter(kind != 1).withColumn("content", F.when(kind == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    odd = c.memories.filter(kind == 3).select(F.col("id").alias("memory_id"), F.lit(True).alias("odd"))
    v = c.embeddings.select("memory_id", "vector")
    changed = v.join(odd, "memory_id", "left").select(
        "memory_id", F.when(F.col("odd"), F.reverse("vector")).otherwise(F.col("vector")).alias("vector"))
    mapping = c.registered.filter("first_call_id % 31 <> 0").select(F.col("id").alias("source_id"))
    return audits.shared_corpus_mismatches(c.memories, second, v, changed, mapping)
