"""Provenance graph: closures, roots, components.

Parents are exactly one level below their child, so every closure ends after
at most ``max(depth)`` rounds and each round is one equi join.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_measured, durable, numbered

ROUNDS_PER_CUT = 4


def max_depth(memories: DataFrame) -> int:
    return memories.agg(F.max("depth")).first()[0] or 0


def ancestor_closure(starts: DataFrame, derived_from: DataFrame, depth: int) -> DataFrame:
    """(start, memory) pairs reachable through derived_from, the start included.

    ``starts`` has the columns ``start`` and ``memory_id``. Rounds are disjoint
    by distance only on layered graphs, so the union is made distinct once.
    """
    edges = derived_from.select(F.col("child_id").alias("memory_id"), "parent_id")
    frontier = starts.select("start", "memory_id").distinct()
    levels = [frontier]
    for round_no in range(depth):
        frontier = (frontier.join(edges, "memory_id")
                    .select("start", F.col("parent_id").alias("memory_id")).distinct())
        if (round_no + 1) % ROUNDS_PER_CUT == 0:
            frontier = durable(frontier)
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.distinct()


def trace_provenance(starts: DataFrame, memories: DataFrame, derived_from: DataFrame,
                     depth: int | None = None) -> DataFrame:
    """Ancestors of every start in depth-first pre-order.

    A depth-first walk with sorted parents reaches a node first along the
    smallest path of ids, so sorting by that path gives the visit order.
    """
    depth = max_depth(memories) if depth is None else depth
    edges = derived_from.select(F.col("child_id").alias("memory_id"), "parent_id")
    frontier = starts.select("start", F.col("start").alias("memory_id"),
                             F.array("start").alias("path"))
    levels = [frontier]
    for round_no in range(depth):
        frontier = (frontier.join(edges, "memory_id")
                    .select("start", F.col("parent_id").alias("memory_id"),
                            F.concat("path", F.array("parent_id")).alias("path"))
                    .groupBy("start", "memory_id").agg(F.min("path").alias("path")))
        if (round_no + 1) % ROUNDS_PER_CUT == 0:
            frontier = durable(frontier)
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    reached = out.groupBy("start", "memory_id").agg(F.min("path").alias("path"))
    known = memories.select(F.col("id").alias("memory_id"), "depth", "source_ref")
    # one start may reach a third of the graph: number it branch by branch
    visits = numbered(reached, ["start"], F.slice("path", 1, 2), [F.col("path")], "visit")
    return (visits.join(known, "memory_id", "left")
            .withColumn("broken", F.col("depth").isNull()))


def trace_sources(trace: DataFrame) -> DataFrame:
    return (trace.filter(F.col("source_ref").isNotNull())
            .select("start", F.col("source_ref").alias("source_id")).distinct())


def source_roots(memories: DataFrame, derived_from: DataFrame, depth: int | None = None) -> DataFrame:
    """(memory, source) for every memory, built layer by layer."""
    depth = max_depth(memories) if depth is None else depth
    layer = (memories.filter(F.col("source_ref").isNotNull())
             .select(F.col("id").alias("memory_id"), F.col("source_ref").alias("source_id")))
    out = layer
    for round_no in range(depth):
        layer = (derived_from.join(layer, derived_from.parent_id == layer.memory_id)
                 .select(F.col("child_id").alias("memory_id"), "source_id").distinct())
        if (round_no + 1) % ROUNDS_PER_CUT == 0:
            layer = durable(layer)
        out = out.unionByName(layer)
    return out.distinct()


def roots_of(starts: DataFrame, memories: DataFrame, derived_from: DataFrame, depth: int) -> DataFrame:
    """(memory, source) as ``source_roots`` has them, for the memories of ``starts(memory_id)`` alone.

    Their ancestors are followed, so a set that is small against the corpus
    goes to the edges and memories, which are scanned in place.
    """
    frontier = broadcast_measured(starts.select(F.col("memory_id").alias("start"), "memory_id").distinct())
    edges = derived_from.select(F.col("child_id").alias("memory_id"), "parent_id")
    out = frontier
    for _ in range(depth):
        frontier = broadcast_measured(edges.join(frontier, "memory_id").select("start", F.col("parent_id").alias("memory_id")).distinct())
        out = out.unionByName(frontier)
    known = memories.filter(F.col("source_ref").isNotNull()).select(F.col("id").alias("memory_id"), F.col("source_ref").alias("source_id"))
    return (known.join(broadcast_measured(out.distinct()), "memory_id")
            .select(F.col("start").alias("memory_id"), "source_id").distinct())


def bounded_ancestry(start: str, memories: DataFrame, derived_from: DataFrame,
                     limit: int = 200) -> tuple[DataFrame, bool]:
    """Ancestors of one memory taken in id order, at most ``limit`` of them.

    The expansion order depends on every node taken so far, so one start is
    walked step by step: the open set lives on the driver and is bounded by
    the limit, each step reads the parents of a batch of open nodes.
    """
    if memories.filter((F.col("id") == start) & F.col("sealed")).isEmpty():
        return memories.limit(0), False
    taken: list[str] = []
    seen, parents = {start}, {}
    open_ids = [start]
    while open_ids and len(taken) <= limit:
        open_ids.sort()
        wanted = [i for i in open_ids[:limit + 1 - len(taken)] if i not in parents]
        if open_ids[0] not in parents:
            # only the smallest limit+1 parents of a node can ever be taken
            rows = (derived_from.filter(F.col("child_id").isin(wanted))
                    .withColumn("n", F.row_number().over(
                        Window.partitionBy("child_id").orderBy("parent_id")))
                    .filter(F.col("n") <= limit + 1).collect())
            for child in wanted:
                parents[child] = []
            for row in rows:
                parents[row.child_id].append(row.parent_id)
        node = open_ids.pop(0)
        taken.append(node)
        for parent in parents[node]:
            if parent not in seen:
                seen.add(parent)
                open_ids.append(parent)
    kept = taken[:limit]
    rows = memories.filter(F.col("id").isin(kept)).orderBy(F.desc("depth"), "id")
    return rows, len(taken) > limit


def merge_walks(walks: list[list[str]] | None, limit: int) -> list[str]:
    """One walk out of several: always the smallest next id of any, each id once, at most ``limit``."""
    heads = [(walk[0], n, 0) for n, walk in enumerate(walks or [])]
    heapq.heapify(heads)
    out, taken = [], set()
    while heads and len(out) < limit:
        node, n, place = heads[0]
        if node not in taken:
            taken.add(node)
            out.append(node)
        if place + 1 < len(walks[n]):
            heapq.heapreplace(heads, (walks[n][place + 1], n, place + 1))
        else:
            heapq.heappop(heads)
    return out


def bounded_walks(memories: DataFrame, derived_from: DataFrame, limit: int) -> DataFrame:
    """(memory_id, walk): the first ``limit`` ids of every memory's walk in id order, itself first.

    The walk always takes the smallest id among the parents of what it took. A
    node's walk is itself and then the merge of its parents' walks by their
    smallest next ids. Whatever precedes a node in a parent's walk also precedes
    it in the child's: the child has all that parent's choices open and stops at
    none of them for a larger id. So the first ``limit`` ids of the parents'
    walks hold all that can be taken, no closure is built, and there is one round
    a depth. A parent that is not loaded is a walk of its own id. Only the
    ``limit`` smallest parents of a node can be taken, so a row holds at most
    ``limit`` lists of ``limit`` ids.
    """
    smallest = Window.partitionBy("child_id").orderBy("parent_id")
    edges = durable(derived_from.select("child_id", "parent_id").distinct()
                    .withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= limit)
                    .join(memories.select(F.col("id").alias("child_id"), "depth"), "child_id")
                    .select("child_id", "parent_id", "depth"))
    merged = F.udf(lambda walks: merge_walks(walks, limit - 1), "array<string>")
    out = below = None
    for depth in range(max_depth(memories) + 1):
        here = memories.filter(F.col("depth") == depth).select(F.col("id").alias("memory_id"))
        walk = F.array("memory_id")
        if below is not None:
            parents = edges.filter(F.col("depth") == depth).select(F.col("child_id").alias("memory_id"), "parent_id")
            lists = (parents.join(below.withColumnsRenamed({"memory_id": "parent_id"}), "parent_id", "left")
                     .groupBy("memory_id").agg(F.collect_list(F.coalesce("walk", F.array("parent_id"))).alias("walks")))
            here = here.join(lists, "memory_id", "left")
            walk = F.when(F.col("walks").isNull(), walk).otherwise(F.concat(walk, merged("walks")))
        below = durable(here.select("memory_id", walk.alias("walk")))
        out = below if out is None else out.unionByName(below)
    return out


def bounded_ancestry_all(memories: DataFrame, derived_from: DataFrame, limit: int = 200) -> DataFrame:
    """The same bound for every memory: (start, memory_id, depth, position, truncated)."""
    starts = memories.filter("sealed").select(F.col("id").alias("memory_id"))
    walks = bounded_walks(memories, derived_from, limit + 1).join(starts, "memory_id", "left_semi")
    kept = walks.select(F.col("memory_id").alias("start"), (F.size("walk") > limit).alias("truncated"),
                        F.explode(F.slice("walk", 1, limit)).alias("memory_id"))
    order = Window.partitionBy("start").orderBy(F.desc("depth"), "memory_id")
    return (kept.join(memories.select(F.col("id").alias("memory_id"), "depth"), "memory_id")
            .select("start", "memory_id", "truncated", "depth", F.row_number().over(order).alias("position")))


def component_roots(operations: DataFrame) -> DataFrame:
    """(id, root) of every operation by pointer doubling over parent_id.

    Every operation has at most one parent, so a component is a tree and its
    top names it. Chains of length n need log2(n) rounds.
    """
    pointers = operations.select(
        "id", F.coalesce("parent_id", "id").alias("root"))
    # parents that are themselves not recorded still connect their children
    absent = (operations.select(F.col("parent_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
              .join(operations.select("id"), "id", "left_anti").select("id", F.col("id").alias("root")))
    pointers = durable(pointers.unionByName(absent))
    while True:
        ahead = pointers.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = durable(pointers.join(ahead, "root").select("id", "root", "next"))
        if step.filter(F.col("root") != F.col("next")).isEmpty():
            return pointers
        pointers = step.select("id", F.col("next").alias("root"))


def activity_components(operations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(date, id): all operations connected to a day's seed operations."""
    roots = component_roots(operations)
    hit = seeds.join(roots, "id").select("date", "root").distinct()
    return hit.join(roots, "root").select("date", "id").distinct()
