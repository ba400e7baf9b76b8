"""Graph operators against brute force on small graphs."""

import heapq
import random

from pyspark.sql import functions as F

from memstrata.config import EngineConfig
from memstrata.operators import evaluation, graph, neighbourhoods
from memstrata.sources.corpus import Corpus

MEMORY = "id string, depth int, source_ref string, sealed boolean"


def layered(spark, seed=3, widths=(9, 6, 4, 2)):
    rnd = random.Random(seed)
    nodes, edges = [], []
    for d, width in enumerate(widths):
        for i in range(width):
            nodes.append((f"m{d}_{rnd.randrange(1000):03d}_{i}", d, f"s{i % 5}" if d == 0 else None, True))
            if d:
                below = [n[0] for n in nodes if n[1] == d - 1]
                edges += [(nodes[-1][0], p) for p in rnd.sample(below, min(3, len(below)))]
    return nodes, edges, spark.createDataFrame(nodes, MEMORY), spark.createDataFrame(edges, "child_id string, parent_id string")


def depth_first(start, parents):
    seen = []

    def visit(node):
        if node in seen:
            return
        seen.append(node)
        for p in sorted(parents.get(node, ())):
            visit(p)
    visit(start)
    return seen


def as_map(edges):
    out = {}
    for child, parent in edges:
        out.setdefault(child, []).append(parent)
    return out


def test_trace_is_depth_first(spark):
    for seed in (1, 2, 5):
        nodes, edges, m, d = layered(spark, seed)
        trace = graph.trace_provenance(m.select(F.col("id").alias("start")), m, d).collect()
        got = {}
        for row in sorted(trace, key=lambda r: (r.start, r.visit)):
            got.setdefault(row.start, []).append(row.memory_id)
        assert got == {n[0]: depth_first(n[0], as_map(edges)) for n in nodes}


def test_trace_reports_missing_parent(spark):
    m = spark.createDataFrame([("a", 1, None, True)], MEMORY)
    d = spark.createDataFrame([("a", "gone")], "child_id string, parent_id string")
    rows = graph.trace_provenance(m.select(F.col("id").alias("start")), m, d, 1).collect()
    assert {r.memory_id: r.broken for r in rows} == {"a": False, "gone": True}


def by_smallest_id(start, parents, limit):
    taken, seen, heap = [], {start}, [start]
    while heap and len(taken) <= limit:
        node = heapq.heappop(heap)
        taken.append(node)
        for p in parents.get(node, ()):
            if p not in seen:
                seen.add(p)
                heapq.heappush(heap, p)
    return taken[:limit], len(taken) > limit


def test_bounded_ancestry_matches_the_id_ordered_walk(spark):
    nodes, edges, m, d = layered(spark, 7)
    parents = as_map(edges)
    limit = 4
    got = {}
    for row in graph.bounded_ancestry_all(m, d, limit).collect():
        got.setdefault(row.start, (set(), row.truncated))[0].add(row.memory_id)
    for node, *_ in nodes:
        want, truncated = by_smallest_id(node, parents, limit)
        assert got[node] == (set(want), truncated)
    start = nodes[-1][0]
    rows, truncated = graph.bounded_ancestry(start, m, d, limit)
    want, flag = by_smallest_id(start, parents, limit)
    assert {r.id for r in rows.collect()} == set(want) and truncated == flag


def test_merged_walks_are_the_walk_in_id_order():
    rnd = random.Random(4)
    for case in range(300):
        widths = [rnd.randrange(1, 9) for _ in range(rnd.randrange(2, 7))]
        names = rnd.sample(range(100, 999), sum(widths))
        layers = [[str(names.pop()) for _ in range(w)] for w in widths]
        parents = {n: rnd.sample(below, rnd.randrange(0, len(below) + 1))
                   for below, layer in zip(layers, layers[1:]) for n in layer}
        limit = rnd.randrange(1, 12)
        walks = {}
        for layer in layers:
            for n in layer:
                smallest = sorted(parents.get(n, ()))[:limit + 1]
                walks[n] = [n] + graph.merge_walks([walks[p] for p in smallest], limit)
                want, truncated = by_smallest_id(n, parents, limit)
                assert (walks[n][:limit], len(walks[n]) > limit) == (want, truncated), case


def test_bounded_ancestry_of_unsealed_and_missing_parents(spark):
    m = spark.createDataFrame([("a", 0, "s", True), ("b", 1, None, False), ("c", 2, None, True)], MEMORY)
    d = spark.createDataFrame([("c", "b"), ("c", "gone"), ("b", "a"), ("b", "a")], "child_id string, parent_id string")
    rows = graph.bounded_ancestry_all(m, d, 3).collect()
    assert sorted((r.start, r.memory_id, r.position, r.truncated) for r in rows) == [
        ("a", "a", 1, False), ("c", "a", 3, True), ("c", "b", 2, True), ("c", "c", 1, True)]


def test_components_span_chains_and_missing_parents(spark):
    ops = [(f"o{i}", f"o{i - 1}" if i % 37 else None) for i in range(120)] + [("x", "gone"), ("y", "gone")]
    df = spark.createDataFrame(ops, "id string, parent_id string")
    roots = {r.id: r.root for r in graph.component_roots(df).collect()}
    assert roots["o36"] == "o0" and roots["o73"] == "o37" and roots["x"] == roots["y"] == "gone"
    seeds = spark.createDataFrame([("d", "o5"), ("d", "y")], "date string, id string")
    got = {r.id for r in graph.activity_components(df, seeds).collect()}
    assert got == {f"o{i}" for i in range(37)} | {"x", "y", "gone"}


# ---- neighbourhoods -------------------------------------------------------------

def assemble_by_hand(seed, depth_of, outgoing, near, base, cap):
    chosen, same = [seed], 1

    def add(i):
        nonlocal same
        if len(chosen) < cap and i not in chosen:
            chosen.append(i)
            same += depth_of[i] == depth_of[seed]
    for t in outgoing.get(seed, ()):
        if depth_of[t] == depth_of[seed]:
            add(t)
    for n in near.get(seed, ()):
        if same >= base:
            break
        add(n)
    for t in outgoing.get(seed, ()):
        add(t)
    for n in near.get(seed, ()):
        add(n)
    return chosen


def expand_by_hand(chosen, parents, outgoing, cap):
    chosen, queue = list(chosen), list(chosen)
    while queue and len(chosen) < cap:
        node = queue.pop(0)
        for nxt in [*sorted(parents.get(node, ())), *outgoing.get(node, ())]:
            if len(chosen) < cap and nxt not in chosen:
                chosen.append(nxt)
                queue.append(nxt)
    return chosen


def random_region(spark, seed):
    rnd = random.Random(seed)
    nodes, edges, m, d = layered(spark, seed, (14, 8, 5))
    depth_of = {n[0]: n[1] for n in nodes}
    ids = list(depth_of)
    rel, outgoing, n = [], {}, 0
    for owner in ids:
        for target in rnd.sample(ids, rnd.randrange(5)):
            if target != owner:
                n += 1
                rel.append((n, owner, target, depth_of[target]))
                outgoing.setdefault(owner, []).append(target)
    near, rows = {}, []
    for owner in ids:
        same = [i for i in ids if i != owner and depth_of[i] == depth_of[owner]]
        near[owner] = rnd.sample(same, min(len(same), rnd.randrange(6)))
        rows += [(owner, r + 1, i) for r, i in enumerate(near[owner])]
    return (nodes, edges, m, d, depth_of, outgoing, near,
            spark.createDataFrame(rel, "seq long, memory_id string, related_memory_id string, target_depth int"),
            spark.createDataFrame(rows, "seed_id string, rank int, memory_id string"))


def ordered(df, value="memory_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.seed_id, r.position)):
        out.setdefault(r.seed_id, []).append(r[value])
    return out


def test_neighbourhood_assembly_and_expansion(spark):
    for seed in (1, 4, 9):
        nodes, edges, m, d, depth_of, outgoing, near, rel, rows = random_region(spark, seed)
        seeds = m.select(F.col("id").alias("seed_id"), "depth")
        for base, cap, wide in ((3, 5, 9), (2, 20, 80)):
            hood = neighbourhoods.assemble(seeds, rel, rows, base, cap)
            want = {i: assemble_by_hand(i, depth_of, outgoing, near, base, cap) for i in depth_of}
            assert ordered(hood) == want
            grown = neighbourhoods.expand_outgoing(hood, d, rel, m, wide)
            parents = as_map(edges)
            assert ordered(grown) == {i: expand_by_hand(want[i], parents, outgoing, wide) for i in want}


def test_expansion_on_the_bound_corpus(spark):
    from suite.graphs import hoods
    c = Corpus.of(spark, "/root/testdata/sf0.001")
    cap = EngineConfig().meditation_graph_limit
    got = ordered(neighbourhoods.expand_outgoing(hoods(c), c.derived_from, c.edges, c.memories, cap))
    parents = as_map([(r.child_id, r.parent_id) for r in c.derived_from.collect()])
    outgoing = {}
    for r in c.relations.orderBy("seq").collect():
        outgoing.setdefault(r.memory_id, []).append(r.related_memory_id)
    assert got == {s: expand_by_hand(ids, parents, outgoing, cap) for s, ids in ordered(hoods(c)).items()}


def test_source_evidence_order(spark):
    nodes, edges, m, d, depth_of, outgoing, near, rel, rows = random_region(spark, 2)
    hood = neighbourhoods.assemble(m.select(F.col("id").alias("seed_id"), "depth"), rel, rows, 3, 6)
    source = {n[0]: n[2] for n in nodes}
    parents = as_map(edges)
    want = {}
    for seed, ids in ordered(hood).items():
        queue, seen, found = list(ids), set(), []
        while queue and len(found) < 3:
            node = queue.pop(0)
            if node in seen:
                continue
            seen.add(node)
            if source[node] and source[node] not in found:
                found.append(source[node])
            queue += sorted(parents.get(node, ()))
        want[seed] = found
    assert ordered(neighbourhoods.source_evidence(hood, d, m, 3, 2), "source_id") == want


def test_feasibility_never_combines_depths(spark):
    m = spark.createDataFrame([(f"a{i}", 0, f"s{i}", True) for i in range(3)] + [("b0", 1, None, True), ("b1", 1, None, True)], MEMORY)
    roots = spark.createDataFrame([(f"a{i}", f"s{i}") for i in range(3)] + [("b0", f"r{i}") for i in range(9)], "memory_id string, source_id string")
    sets = spark.createDataFrame([("yes", "a0"), ("yes", "a1"), ("yes", "a2"), ("no", "a0"), ("no", "a1"), ("no", "b0"), ("no", "b1")], "set_id string, memory_id string")
    got = {r.set_id: r.feasible for r in neighbourhoods.abstraction_feasibility(sets, m, roots, 3).collect()}
    assert got == {"yes": True, "no": False}


def test_containment_finds_every_occurrence(spark):
    items = [("q1", "two words"), ("q2", "alpha beta gamma delta eps zeta"), ("q3", "x"), ("q4", "one  two\nthree four five six seven")]
    texts = [("t1", "say two words"), ("t2", "pre-alpha beta gamma delta eps zetas"), ("t3", "alpha beta gamma delta eps"), ("t4", "one two\nthree four five six seven"),
             ("t5", "atwo wordsb one  two\nthree four five six seven"), ("t6", "")]
    got = {(r.query_id, r.id) for r in evaluation.containing_texts(
        spark.createDataFrame(items, "query_id string, text string"), spark.createDataFrame(texts, "id string, raw string")).collect()}
    assert got == {(q, t) for q, a in items for t, b in texts if a in b}


def test_texts_with_a_question_are_found_where_they_are_read(spark):
    import re

    items = spark.createDataFrame([("q1", "the quick brown fox jumps over"), ("q2", "ab"), ("q1", "ab")], "query_id string, text string")
    texts = spark.createDataFrame([(1, "see the quick brown fox jumps over it"), (2, "quick brown fox jumps"), (3, "xaby"), (None, "ab"), (4, None)], "id long, raw string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evaluation.containing_texts(items, texts)
        assert not re.search("SortMergeJoin", found._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(tuple, found.collect())) == [("q1", 1), ("q1", 3), ("q2", 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_roots_of_some_memories_are_those_of_all(spark):
    memories = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("b", "s2"), ("c", None), ("d", None), ("m", "s1")], "id string, source_ref string")
    edges = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("m", "b"), ("x", "a"), (None, "a")], "child_id string, parent_id string")
    whole = {tuple(r) for r in graph.source_roots(memories, edges, 2).collect()}
    some = spark.createDataFrame([("d",), ("d",), ("m",), ("x",), ("nowhere",), (None,)], "memory_id string")
    got = sorted(map(tuple, graph.roots_of(some, memories, edges, 2).collect()))
    assert got == sorted(r for r in whole if r[0] in ("d", "m", "x")) and len(got) == 5
