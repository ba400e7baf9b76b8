"""Graph and provenance operators."""

from pyspark.sql import functions as F

from memstrata.config import EngineConfig
from memstrata.operators import audits, blockmax, graph, neighbourhoods, retrieval
from memstrata.plans import daily_report as report
from memstrata.plans import work

from .aggregates import ZONE, attributed, day_runs, linked_operations
from .joins import NEAREST, nearest_same_depth, queries_in_views, run_seeds, run_views
from .registry import query

CONFIG = EngineConfig()


@query("trace_provenance", """
with recursive_paths as (select 1),
p(start, memory_id, path) as (select id, id, [id] from c_mem union all select p.start, d.parent_id, list_append(p.path, d.parent_id) from p join c_df d on d.child_id = p.memory_id),
f as (select start, memory_id, min(path) path from p group by 1, 2)
select start, memory_id, row_number() over (partition by start order by path) visit, false broken from f""".replace("with recursive_paths as (select 1),\np(", "with p("))
def _(c):
    starts = c.memories.select(F.col("id").alias("start"))
    return graph.trace_provenance(starts, c.memories, c.derived_from).select("start", "memory_id", "visit", "broken")


@query("trace_sources", "select memory_id as start, source_id from c_roots")
def _(c):
    starts = c.memories.select(F.col("id").alias("start"))
    return graph.trace_sources(graph.trace_provenance(starts, c.memories, c.derived_from))


@query("bounded_ancestry", """
select a.start, a.memory_id, m.depth, false truncated, row_number() over (partition by a.start order by m.depth desc, m.id) as position
from c_anc a join c_mem m on m.id = a.memory_id""")
def _(c):
    return graph.bounded_ancestry_all(c.memories, c.derived_from)


#: Below the size of the closures of many memories, so that walks are cut.
SHORT = 5


@query("bounded_ancestry_cut", f"""
with up as (select child_id, list(parent_id) parents from c_df group by 1),
walk(start, taken, waiting) as (
    select id, []::varchar[], [id] from c_mem where sealed
    union all
    select start, list_append(taken, waiting[1]), list_sort(list_distinct(list_filter(
        list_concat(waiting[2:], coalesce(parents, [])), lambda x: not list_contains(taken, x) and x <> waiting[1])))
    from walk left join up on child_id = waiting[1] where len(waiting) > 0 and len(taken) <= {SHORT}),
ends as (select start, max_by(taken, len(taken)) taken from walk group by 1),
kept as (select start, len(taken) > {SHORT} truncated, unnest(taken[:{SHORT}]) memory_id from ends)
select k.start, k.memory_id, m.depth, k.truncated, row_number() over (partition by k.start order by m.depth desc, m.id) as position
from kept k join c_mem m on m.id = k.memory_id""")
def _(c):
    return graph.bounded_ancestry_all(c.memories, c.derived_from, SHORT)


@query("source_roots", "select memory_id, source_id from c_roots")
def _(c):
    return graph.source_roots(c.memories, c.derived_from)


@query("frontier_union", "select distinct memory_id from c_anc where starts_with(start, 'mem_d2_')")
def _(c):
    starts = c.memory_rows.filter("depth = 2").select(F.lit("all").alias("start"), F.col("id").alias("memory_id"))
    return graph.ancestor_closure(starts, c.derived_from, 2).select("memory_id")


@query("abstraction_feasibility", """
with m as (select 'a' || d.child_id set_id, d.parent_id memory_id from c_df d union all select 'b' || child_id, parent_id from (
        select *, row_number() over (partition by child_id order by parent_id) n from c_df) where n <= 2
    union all select 'c' || source_ref, id from c_mem where depth = 0),
x as (select m.set_id, b.depth, count(distinct m.memory_id) n, (select count(distinct r.source_id) from m k join c_roots r on r.memory_id = k.memory_id join c_mem z on z.id = k.memory_id
        where k.set_id = m.set_id and z.depth = b.depth) s from m join c_mem b on b.id = m.memory_id group by 1, 2)
select set_id, bool_or(n >= 3 and s >= pow(3, depth + 1)) feasible from x group by 1""")
def _(c):
    from pyspark.sql import Window
    d = c.derived_from
    two = d.withColumn("n", F.row_number().over(Window.partitionBy("child_id").orderBy("parent_id"))).filter("n <= 2")
    sets = (d.select(F.concat(F.lit("a"), "child_id").alias("set_id"), F.col("parent_id").alias("memory_id"))
            .unionByName(two.select(F.concat(F.lit("b"), "child_id").alias("set_id"), F.col("parent_id").alias("memory_id")))
            .unionByName(c.memories.filter("depth = 0").select(F.concat(F.lit("c"), "source_ref").alias("set_id"), F.col("id").alias("memory_id"))))
    return neighbourhoods.abstraction_feasibility(sets, c.memories, c.roots, CONFIG.root_base)


ASSEMBLE = f"""{NEAREST},
o as (select h.run_id, h.memory_id seed_id, e.related_memory_id memory_id, min(e.seq) place, bool_or(e.target_depth = e.owner_depth) same
    from c_hseed h join c_fedge e on e.memory_id = h.memory_id and e.seq <= h.relation_high_water and e.target_seq <= h.memory_high_water group by 1, 2, 3),
fresh as (select n.run_id, n.seed_id, n.memory_id, n.rank, row_number() over (partition by n.run_id, n.seed_id order by n.rank) k from near n
    left join o on o.run_id = n.run_id and o.seed_id = n.seed_id and o.memory_id = n.memory_id and o.same where o.seed_id is null),
n_same as (select run_id, seed_id, count(*) n from o where same group by 1, 2),
listed as (select run_id, memory_id seed_id, memory_id, 0 stage, 0 place from c_hseed union all select run_id, seed_id, memory_id, 1, place from o where same
    union all select f.run_id, f.seed_id, f.memory_id, 2, rank from fresh f left join n_same s using (run_id, seed_id) where k <= 2 - coalesce(s.n, 0)
    union all select run_id, seed_id, memory_id, 3, place from o union all select run_id, seed_id, memory_id, 4, rank from near),
first_place as (select run_id, seed_id, memory_id, min((stage, place)) p from listed group by 1, 2, 3),
hood as (select f.run_id, f.seed_id, f.memory_id, row_number() over (partition by f.run_id, f.seed_id order by p) as position
    from first_place f join c_runs r on r.id = f.run_id
    qualify row_number() over (partition by f.run_id, f.seed_id order by p) <= case r.kind when 'dream' then 20 else 80 end)"""


def seeds(c):
    """Every run's seeds with their level, what the run sees, and how large its regions may be."""
    cap = F.when(F.col("kind") == "dream", CONFIG.neighbourhood_size).otherwise(CONFIG.meditation_graph_limit)
    return (c.embeddings.select("memory_id", "depth").join(run_seeds(c), "memory_id")
            .select("run_id", F.col("memory_id").alias("seed_id"), "depth", "kind", "memory_high_water", "relation_high_water", cap.alias("cap")))


def dated_edges(c):
    """Relations with their target's place in the order of memories."""
    return c.edges.join(c.memories.select(F.col("id").alias("related_memory_id"), F.col("seq").alias("target_seq")), "related_memory_id")


def run_hoods(c):
    """The region around every run's seeds, in the run's view."""
    return c.space.table("run_hoods", lambda: neighbourhoods.neighbourhoods(
        seeds(c), dated_edges(c), nearest_same_depth(c).withColumnRenamed("query_id", "seed_id"), CONFIG))


def hoods(c):
    """The region that each seed has in its last run."""
    regions = run_hoods(c)
    last = regions.groupBy("seed_id").agg(F.max("run_id").alias("run_id"))
    return regions.join(last, ["run_id", "seed_id"]).drop("run_id")


@query("neighbourhood_assembly", f"with {ASSEMBLE} select run_id, seed_id, memory_id, position from hood")
def _(c):
    return run_hoods(c)


EXPAND = f"""{ASSEMBLE},
steps as (select memory_id, next_id, min((class, torder, norder)) edge from (
    select child_id memory_id, parent_id next_id, 0 class, parent_id torder, 0 norder from c_df
    union all select memory_id, related_memory_id, 1, '', seq from c_edges) where next_id in (select id from c_mem) group by 1, 2),
dated as (select s.*, m.seq next_seq from steps s join c_mem m on m.id = s.next_id),
grow as (
    select h.run_id, h.seed_id, list(h.memory_id order by h.position) members, list(h.memory_id order by h.position) frontier, 0 before
    from hood h join c_runs r on r.id = h.run_id where r.kind = 'meditation' group by 1, 2
    union all
    select run_id, seed_id, list_concat(any_value(members), list_slice(list(next_id order by place), 1, 80 - len(any_value(members)))),
           list_slice(list(next_id order by place), 1, 80 - len(any_value(members))), len(any_value(members))
    from (select f.run_id, f.seed_id, f.members, d.next_id, min((f.pos, d.edge)) place
          from (select run_id, seed_id, members, unnest(frontier) m, unnest(range(before, before + len(frontier))) pos from grow where len(members) < 80) f
          join c_runs r on r.id = f.run_id
          join dated d on d.memory_id = f.m and d.next_seq <= r.memory_high_water and d.edge[3] <= r.relation_high_water
          where not list_contains(f.members, d.next_id) group by 1, 2, 3, 4)
    group by 1, 2),
whole as (select run_id, seed_id, members from grow qualify row_number() over (partition by run_id, seed_id order by len(members) desc) = 1)"""


@query("outgoing_expansion", f"""
with {EXPAND} select run_id, seed_id, unnest(members) memory_id, unnest(range(1, len(members) + 1)) as position from whole""")
def _(c):
    weekly = c.runs.filter("kind = 'meditation'").select(F.col("id").alias("run_id"), "memory_high_water", "relation_high_water")
    regions = run_hoods(c).join(weekly.select("run_id"), "run_id", "left_semi")
    return neighbourhoods.expand_outgoing(regions, c.derived_from, c.edges, c.memories, CONFIG.meditation_graph_limit, weekly)


@query("source_evidence", f"""
with {ASSEMBLE},
l1 as (select h.run_id, h.seed_id, d.parent_id memory_id, min((h.position, d.parent_id)) p from hood h join c_df d on d.child_id = h.memory_id group by 1, 2, 3),
n1 as (select l1.run_id, l1.seed_id, l1.memory_id, row_number() over (partition by l1.run_id, l1.seed_id order by p) place from l1
    left join hood h using (run_id, seed_id, memory_id) where h.seed_id is null),
l2 as (select n1.run_id, n1.seed_id, d.parent_id memory_id, min((n1.place, d.parent_id)) p from n1 join c_df d on d.child_id = n1.memory_id group by 1, 2, 3),
n2 as (select l2.run_id, l2.seed_id, l2.memory_id, row_number() over (partition by l2.run_id, l2.seed_id order by p) place from l2
    left join hood h using (run_id, seed_id, memory_id) left join n1 using (run_id, seed_id, memory_id) where h.seed_id is null and n1.seed_id is null),
v as (select run_id, seed_id, memory_id, 0 lev, position place from hood union all select run_id, seed_id, memory_id, 1, place from n1
    union all select run_id, seed_id, memory_id, 2, place from n2),
s as (select v.run_id, v.seed_id, m.source_ref source_id, min((lev, place)) p from v join c_mem m on m.id = v.memory_id where m.source_ref is not null group by 1, 2, 3)
select run_id, seed_id, source_id, row_number() over (partition by run_id, seed_id order by p) as position from s
qualify row_number() over (partition by run_id, seed_id order by p) <= 12""")
def _(c):
    return neighbourhoods.source_evidence(run_hoods(c), c.derived_from, c.memories, CONFIG.meditation_source_limit, 2)


def assimilation_seeds(c):
    """The daily runs' new memories, with what their run sees."""
    return c.run_work.filter("phase = 'assimilation'").select("run_id", "memory_id").join(run_views(c), "run_id")


def lexical_in_views(c):
    """The best lexical hits of each assimilated memory's content in its run's view."""
    def build():
        texts = c.memories.select(F.col("id").alias("memory_id"), F.col("content").alias("text"))
        queries = (assimilation_seeds(c).join(texts, "memory_id")
                   .select("run_id", F.col("memory_id").alias("query_id"), "text", F.col("memory_high_water").alias("high_water")))
        segments = c.space.table("segments", lambda: blockmax.build_segments(c.postings, c.collection))
        return blockmax.frozen_search(queries, segments, c.frequencies, c.collection, CONFIG.search_candidates, postings=c.postings, memories=c.memories)
    return c.space.table("lexical_in_views", build)


def hybrid_in_views(c):
    """(run_id, query_id, rank, memory_id): both rankings of each assimilated memory's content, fused."""
    keys = ["run_id", "query_id", "rank", "memory_id"]
    semantic = retrieval.nearest_in_views(queries_in_views(c, assimilation_seeds(c), False), c.embeddings, CONFIG.search_candidates)
    return retrieval.fuse(lexical_in_views(c).select(*keys).unionByName(semantic.select(*keys)), CONFIG.search_candidates, ("run_id", "query_id"))


@query("assimilation_candidates", """
with listed as (select a.run_id, a.seed_id, e.related_memory_id memory_id, 0 stage, e.seq place
        from c_aseed a join c_fedge e on e.memory_id = a.seed_id and e.seq <= a.relation_high_water and e.target_seq <= a.memory_high_water
    union all select run_id, seed_id, memory_id, 1, rank from c_ahits),
f as (select run_id, seed_id, memory_id, min((stage, place)) p from listed where memory_id <> seed_id group by 1, 2, 3)
select run_id, seed_id, memory_id, row_number() over (partition by run_id, seed_id order by p) as position from f
qualify row_number() over (partition by run_id, seed_id order by p) <= 30""")
def _(c):
    own = assimilation_seeds(c).select("run_id", F.col("memory_id").alias("seed_id"), "memory_high_water", "relation_high_water")
    found = hybrid_in_views(c).withColumnRenamed("query_id", "seed_id")
    return neighbourhoods.assimilation_candidates(own, dated_edges(c), found, CONFIG.search_candidates)


@query("frozen_lexical_hits", "select run_id, seed_id query_id, memory_id, rank from c_alex")
def _(c):
    return lexical_in_views(c).select("run_id", "query_id", "memory_id", "rank")


@query("session_ancestry_errors", """
select id memory_id, 'unmapped source' problem from c_mem where depth = 0 and seq % 11 <> 0 and source_ref in (select id from c_reg where first_call_id % 29 = 0)
union all select child_id, 'missing parent' from c_df where child_id not in ('mem_d1_1', 'mem_d2_1') and child_id in (select id from c_mem where seq % 11 <> 0) and parent_id in (select id from c_mem where seq % 11 = 0) group by 1
union all select m.id, 'abstraction without parents' from c_mem m where m.depth > 0 and m.seq % 11 <> 0 and m.id in ('mem_d1_1', 'mem_d2_1')""")
def _(c):
    from memstrata.operators.evaluation import ancestry_errors
    kept = c.memories.filter("seq % 11 <> 0")
    mapping = c.registered.filter("first_call_id % 29 <> 0").select(F.col("id").alias("source_id"))
    cut = c.derived_from.filter("child_id not in ('mem_d1_1', 'mem_d2_1')")
    return ancestry_errors(kept, cut, mapping)


@query("activity_component", "select cast(date as varchar) date, id from c_dayops")
def _(c):
    return report.day_operations(c.operations, attributed(c), ZONE)


@query("report_memory_closure", """
with o as (select d.date, o.* from c_dayops d join c_ops o on o.id = d.id),
named as (select o.date, r.id memory_id from o join c_reflist r on r.event_id = o.event_id and r.role <> 'source'
    union select date, seed_id from o where seed_id is not null
    union select cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date), id from c_mem
    union select d.date, w.memory_id from c_dayruns d join c_work w on w.run_id = d.run_id
    union select x.date, unnest([r.memory_id, r.related_memory_id]) from c_results r join (
        select distinct date, run_id, work_key from o where run_id is not null) x on x.run_id = r.run_id and x.work_key = r.work_key
    union select cast(timezone('Asia/Seoul', timezone('UTC', "at")) as date), unnest([memory_id, related_memory_id]) from c_results)
select distinct cast(n.date as varchar) date, coalesce(a.memory_id, n.memory_id) memory_id from named n left join c_anc a on a.start = n.memory_id""")
def _(c):
    return report.report_memories(c.activity, linked_operations(c), day_runs(c), c.run_work, c.relation_results,
                                  c.memory_rows, c.derived_from, ZONE)


@query("report_sources", """
with o as (select d.date, o.* from c_dayops d join c_ops o on o.id = d.id),
made as (select cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date) date, id memory_id from c_mem)
select distinct cast(date as varchar) date, source_id from (
    select m.date, r.source_id from made m join c_roots r on r.memory_id = m.memory_id union all select date, source_id from o where source_id is not null)""")
def _(c):
    created = report.on_date(c.memory_rows, "created_at", ZONE).select(F.col("date").alias("start"), F.col("id").alias("memory_id"))
    closure = graph.ancestor_closure(created, c.derived_from, 2).withColumnRenamed("start", "date")
    return report.report_sources(closure, linked_operations(c), c.operations, c.memory_rows)


@query("changed_memories", "select run_id, memory_id from c_changed")
def _(c):
    return work.changed_memories(c.memory_rows, c.relations, c.runs)


# ---- audits ---------------------------------------------------------------------

@query("graph_invariant_audit", """
select 'depth and origin disagree' as rule, id as key from c_mem where seq % 97 = 3 and depth = 0
union all select 'blank content', id from c_mem where seq % 97 = 5
union all select 'relation kind', seq::varchar from c_rel where seq % 41 = 0
union all select 'self relation', seq::varchar from c_rel where seq % 43 = 0
union all select 'source status', id from c_reg where first_call_id % 61 = 0
union all select 'fewer than B parents', child_id from (select child_id, count(*) filter (parent_id > (select min(x.parent_id) from c_df x where x.child_id = d.child_id and starts_with(x.child_id, 'mem_d2_'))
    or not starts_with(child_id, 'mem_d2_')) n from c_df d group by 1) where n < 3""")
def _(c):
    kind = F.col("seq") % 97
    m = c.memories.withColumns({
        "dream_revision": F.when((kind == 3) & (F.col("depth") == 0), 5).otherwise(F.col("dream_revision")),
        "content": F.when(kind == 5, "  ").otherwise(F.col("content"))})
    r = c.relations.withColumns({
        "kind": F.when(F.col("seq") % 41 == 0, "neutral").otherwise(F.col("kind")),
        "related_memory_id": F.when(F.col("seq") % 43 == 0, F.col("memory_id")).otherwise(F.col("related_memory_id"))})
    s = c.registered.withColumn("status", F.when(F.col("first_call_id") % 61 == 0, "lost").otherwise(F.col("status")))
    lowest = c.derived_from.filter("child_id like 'mem\\_d2\\_%'").groupBy("child_id").agg(F.min("parent_id").alias("parent_id"))
    d = c.derived_from.join(lowest, ["child_id", "parent_id"], "left_anti")
    return audits.graph_violations(m, d, c.roots, r, s, CONFIG)


@query("history_immutability_audit", """
select 'deleted memories' as rule, id as key from c_mem where seq % 53 = 1
union all select 'changed memories', id from c_mem where seq % 53 = 2
union all select 'unsealed memory', id from c_mem where seq % 53 = 3
union all select 'deleted derived_from', child_id || '|' || parent_id from c_df where parent_id in (select id from c_mem where seq % 59 = 4)
union all select 'changed relations', memory_id || '|' || related_memory_id || '|' || kind from c_rel where seq % 37 = 1
union all select 'changed sources', id from c_reg where first_call_id % 47 = 0""")
def _(c):
    k = F.col("seq") % 53
    old = {"memories": c.memories, "sources": c.registered, "derived_from": c.derived_from, "memory_roots": c.roots, "relations": c.relations}
    hidden = c.memories.filter("seq % 59 = 4").select(F.col("id").alias("parent_id"))
    new = dict(old)
    new["memories"] = (c.memories.filter(k != 1).withColumn("content", F.when(k == 2, "edited").otherwise(F.col("content")))
                       .withColumn("sealed", k != 3))
    new["derived_from"] = c.derived_from.join(hidden, "parent_id", "left_anti")
    new["relations"] = c.relations.withColumn("run_id", F.when(F.col("seq") % 37 == 1, 0).otherwise(F.col("run_id")))
    new["sources"] = c.registered.withColumn("relative_path", F.when(F.col("first_call_id") % 47 == 0, "moved").otherwise(F.col("relative_path")))
    return audits.history_violations(old, new)
