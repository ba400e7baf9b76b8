"""Rules that decide over proposed abstractions, relations, labels and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import scalars as S
from ..session import durable

PROPOSAL_KEY = ["run_id", "work_key", "proposal_index"]

# rule codes of rejected proposals
BLANK_CONTENT = "content_blank"
LONG_CONTENT = "content_too_long"
FEW_PARENTS = "parents_below_base"
PARENT_REASONS = {
    1: "parent_not_offered",
    2: "parent_unknown",
    3: "parent_not_before_run",
    4: "parent_depths_differ",
}
FEW_ROOTS = "roots_below_power"
ONE_PER_DAY = "second_of_neighbourhood"
FINISHED_RUN = "run_finished"
RELATION_RULE = "relation_not_sound"
OUTSIDE_SNAPSHOT = "relation_outside_snapshot"


def _reason(code):
    out = F.lit(None).cast("string")
    for number, text in PARENT_REASONS.items():
        out = F.when(code == number, text).otherwise(out)
    return out


def validate_abstractions(proposals: DataFrame, memories: DataFrame, roots: DataFrame, runs: DataFrame,
                          config: EngineConfig) -> DataFrame:
    """Verdict per proposal: reason (null when accepted), depth and root count.

    ``proposals(run_id, work_key, proposal_index, content, derived_from, allowed)``.
    Parent rules are judged per parent and the smallest (position, rule) is the
    first failure; sources are counted distinct over all parents.
    """
    parents_n = F.size("derived_from")
    base = proposals.withColumn(
        "early", F.when(S.is_blank(F.col("content")), BLANK_CONTENT)
        .when(S.utf16_length(F.col("content")) > config.max_memory_characters, LONG_CONTENT)
        .when((parents_n < config.root_base) | (F.size(F.array_distinct("derived_from")) != parents_n),
              FEW_PARENTS))
    run = runs.select(F.col("id").alias("run_id"), "memory_high_water")
    known = memories.filter("sealed").select(
        F.col("id").alias("parent_id"), "seq", "depth", F.col("dream_revision").alias("revision"))
    parents = (base.filter(F.col("early").isNull()).join(run, "run_id")
               .select(*PROPOSAL_KEY, "memory_high_water", F.posexplode("derived_from").alias("pos", "parent_id"),
                       "allowed")
               .withColumn("offered", F.array_contains("allowed", F.col("parent_id"))).drop("allowed")
               .join(known, "parent_id", "left"))
    lead = Window.partitionBy(*PROPOSAL_KEY).orderBy("pos")
    rule = (F.when(~F.col("offered"), 1).when(F.col("depth").isNull(), 2)
            .when((F.col("revision") >= F.col("run_id")) | (F.col("seq") > F.col("memory_high_water")), 3)
            .when(F.col("depth") != F.col("lead_depth"), 4))
    judged = parents.withColumn("lead_depth", F.first("depth").over(lead)).withColumn("rule", rule)
    firsts = judged.groupBy(*PROPOSAL_KEY).agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct("pos", "rule"))).alias("failed"),
        F.max("lead_depth").alias("parent_depth"))
    sound = firsts.filter(F.col("failed").isNull()).select(*PROPOSAL_KEY)
    evidence = (judged.select(*PROPOSAL_KEY, "parent_id").join(sound, PROPOSAL_KEY, "left_semi")
                .join(roots.select(F.col("memory_id").alias("parent_id"), "source_id"), "parent_id")
                .groupBy(*PROPOSAL_KEY).agg(F.countDistinct("source_id").alias("n_roots")))
    depth = F.col("parent_depth") + 1
    enough = F.coalesce("n_roots", F.lit(0)) >= S.root_threshold(config.root_base, depth)
    reason = (F.when(F.col("early").isNotNull(), F.col("early"))
              .when(F.col("failed").isNotNull(), _reason(F.col("failed.rule")))
              .when(~enough, FEW_ROOTS))
    return (base.join(firsts, PROPOSAL_KEY, "left").join(evidence, PROPOSAL_KEY, "left")
            .withColumn("reason", reason)
            .withColumn("depth", F.when(F.col("reason").isNull(), depth))
            .withColumn("n_roots", F.when(F.col("reason").isNull(), F.col("n_roots")))
            .drop("early", "failed", "parent_depth"))


def apply_abstractions(verdicts: DataFrame, memories: DataFrame, roots: DataFrame, runs: DataFrame,
                       at, model: str) -> dict[str, DataFrame]:
    """New rows of accepted proposals: memories, edges, roots and rejections.

    Applying again adds nothing, because the origin key identifies the output.
    A daily run accepts index 0 only; finished runs accept nothing.
    """
    run = runs.select(F.col("id").alias("run_id"), "kind", F.col("status").alias("run_status"))
    keyed = (verdicts.join(run, "run_id")
             .withColumn("origin_key", S.run_origin_key(F.col("run_id"), F.col("work_key"), F.col("proposal_index"))))
    todo = keyed.join(memories.select("origin_key"), "origin_key", "left_anti")
    reason = (F.when((F.col("kind") == "dream") & (F.col("proposal_index") >= 1),
                     ONE_PER_DAY)
              .when(F.col("reason").isNotNull(), F.col("reason"))
              .when(~F.col("run_status").isin("running", "budget_exhausted"), FINISHED_RUN))
    # written, as each of the tables below reads it
    judged = durable(todo.withColumn("reason", reason).withColumn(
        "id", F.concat(F.lit("mem_"), F.substring(F.sha2("origin_key", 256), 1, 32))).select(
        *PROPOSAL_KEY, "id", "depth", "content", "derived_from", "origin_key", "reason"))
    accepted = judged.filter(F.col("reason").isNull())
    new_memories = accepted.select(
        "id", "depth", "content", F.lit(None).cast("string").alias("source_ref"), F.lit(at).alias("created_at"),
        F.col("run_id").alias("dream_revision"), F.lit(model).alias("created_by_model"), "origin_key",
        F.lit(True).alias("sealed"))
    edges = accepted.select(F.col("id").alias("child_id"), F.explode("derived_from").alias("parent_id"))
    new_roots = (edges.join(roots.select(F.col("memory_id").alias("parent_id"), "source_id"), "parent_id")
                 .select(F.col("child_id").alias("memory_id"), "source_id").distinct())
    return {"memories": new_memories, "derived_from": edges, "memory_roots": new_roots,
            "rejected": judged.filter(F.col("reason").isNotNull()).select(*PROPOSAL_KEY, "reason")}


def with_vectors(applied: dict[str, DataFrame], vectors: DataFrame, space: str, dimensions: int) -> dict[str, DataFrame]:
    """The rows of ``apply_abstractions`` that may be stored: a memory and its vector come together or not at all.

    ``vectors(id, vector)`` are keyed by the new memory's id. A memory without a
    vector, or with one of another length, with a number that is not finite, or
    of zeros alone, is withheld with its edges and roots: it is listed under
    ``withheld`` with the reason and is neither applied nor rejected, so a later
    attempt with a vector adds it. Of several vectors of an id one that is sound is taken,
    the smallest, so a repeated attempt stores the same.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("vector")
    fault = (F.when(v.isNull(), "no vector").when(F.size(v) != dimensions, "wrong dimensions")
             .when(F.exists(v, bad), "not finite").when(F.forall(v, lambda x: x == 0), "zero vector"))
    one = (vectors.select("id", fault.alias("fault"), "vector").groupBy("id")
           .agg(F.min(F.struct(F.col("fault").isNotNull().alias("unsound"), "fault", "vector")).alias("v"))
           .select("id", "v.fault", "v.vector", F.lit(True).alias("given")))
    judged = applied["memories"].join(one, "id", "left").withColumn(
        "fault", F.when(F.col("given").isNull(), "no vector").otherwise(F.col("fault"))).drop("given")
    sound = judged.filter("fault is null")
    ids = sound.select("id")
    return {**applied, "memories": sound.drop("fault", "vector"),
            "embeddings": sound.select(F.col("id").alias("memory_id"), F.lit(space).alias("space"), F.lit(dimensions).alias("dimensions"), "vector"),
            "derived_from": applied["derived_from"].join(ids.withColumnRenamed("id", "child_id"), "child_id", "left_semi"),
            "memory_roots": applied["memory_roots"].join(ids.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi"),
            "withheld": judged.filter("fault is not null").select("id", "origin_key", F.col("fault").alias("reason"))}


def validate_relations(proposals: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``proposals(run_id, work_key, proposal_index, memory_id, related_memory_id, kind, seed_id, allowed)``."""
    visible = snapshot.select(F.col("id").alias("memory_id"), F.lit(True).alias("visible"))
    tagged = proposals.join(visible, "memory_id", "left").withColumn(
        "sound", F.array_contains("allowed", F.col("memory_id")) & F.coalesce("visible", F.lit(False))
        & (F.col("related_memory_id") == F.col("seed_id")) & (F.col("memory_id") != F.col("seed_id"))
        & F.col("kind").isin("positive", "negative"))
    # the first of equal proposals is found by a combining aggregate and marked
    # through the proposal key, so many equal proposals never meet in one task
    first = (tagged.filter("sound").groupBy("run_id", "work_key", "memory_id", "related_memory_id", "kind")
             .agg(F.min("proposal_index").alias("proposal_index"))
             .select(*PROPOSAL_KEY, F.lit(True).alias("accepted")))
    return (tagged.join(first, PROPOSAL_KEY, "left")
            .withColumn("reason", F.when(F.col("accepted").isNull(), RELATION_RULE))
            .drop("visible", "sound", "accepted"))


def apply_relations(verdicts: DataFrame, memories: DataFrame, relations: DataFrame, runs: DataFrame,
                    recorded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new relations, outcome per proposal).

    In work order the first proposal of an (owner, target, kind) is appended,
    later and already stored ones exist already. ``verdicts`` carries
    ``ordinal`` and ``at``. Outcomes recorded earlier are never changed.
    """
    run = runs.select(F.col("id").alias("run_id"), "memory_high_water")
    ends = memories.filter("sealed").select("id", "seq", F.col("dream_revision").alias("revision"))
    owner = ends.select(F.col("id").alias("memory_id"), F.col("seq").alias("o_seq"), F.col("revision").alias("o_rev"))
    target = ends.select(F.col("id").alias("related_memory_id"), F.col("seq").alias("t_seq"), F.col("revision").alias("t_rev"))
    checked = (verdicts.join(run, "run_id").join(owner, "memory_id", "left").join(target, "related_memory_id", "left"))
    inside = ((F.col("o_seq") <= F.col("memory_high_water")) & (F.col("t_seq") <= F.col("memory_high_water"))
              & (F.col("o_rev") < F.col("run_id")) & (F.col("t_rev") < F.col("run_id")))
    checked = checked.withColumn(
        "reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.coalesce(inside, F.lit(False)), OUTSIDE_SNAPSHOT))
    triple = ["memory_id", "related_memory_id", "kind"]
    first = (checked.filter(F.col("reason").isNull()).groupBy(*triple)
             .agg(F.min(F.struct("run_id", "ordinal", "work_key", "proposal_index")).alias("f"))
             .join(relations.select(*triple), triple, "left_anti")
             .select("f.run_id", "f.work_key", "f.proposal_index", F.lit(True).alias("won")))
    outcome = (F.when(F.col("reason").isNotNull(), "rejected")
               .when(F.col("won"), "appended").otherwise("already_exists"))
    judged = checked.join(first, PROPOSAL_KEY, "left").withColumn("outcome", outcome)
    new = judged.filter("outcome = 'appended'").select(*triple, F.col("at").alias("related_at"), "run_id")
    outcomes = judged.select(*PROPOSAL_KEY, "at", "outcome", *triple, "reason")
    if recorded is not None:
        outcomes = outcomes.join(recorded.select(*PROPOSAL_KEY), PROPOSAL_KEY, "left_anti").unionByName(
            recorded.select(*outcomes.columns))
    return new, outcomes


def first_outcomes(attempts: DataFrame) -> DataFrame:
    """The outcome written first per (run, work, index); re-application changes nothing.

    ``min_by`` combines on the map side, so a key that is repeated many times
    is reduced before the shuffle.
    """
    columns = [c for c in attempts.columns if c not in PROPOSAL_KEY]
    first = F.min(F.struct("at", "attempt", *[c for c in columns if c not in ("at", "attempt")])).alias("f")
    return attempts.groupBy(*PROPOSAL_KEY).agg(first).select(*PROPOSAL_KEY, "f.*")


def validate_observations(observations: DataFrame, config: EngineConfig) -> DataFrame:
    """Verdict per source, all or nothing: ``observations(source_id, position, id, content, model, vector)``."""
    bad_content = S.is_blank(F.col("content")) | (S.utf16_length(F.col("content")) > config.max_memory_characters)
    per_id = (observations.withColumn("bad_content", bad_content)
              .withColumn("bad_vector", ~F.coalesce(S.vector_is_valid(F.col("vector")), F.lit(False)))
              .groupBy("source_id", "id").agg(
                  F.count("*").alias("n"), F.max("bad_content").alias("bad_content"), F.max("bad_vector").alias("bad_vector")))
    blank_id = F.col("id").isNull() | S.is_blank(F.col("id"))
    return (per_id.groupBy("source_id").agg(
        F.sum("n").alias("n"), F.max("bad_content").alias("bad_content"), F.max("bad_vector").alias("bad_vector"),
        F.max(blank_id).alias("blank_id"), F.max(F.col("n") > 1).alias("repeated_id"))
        .select("source_id", "n", F.when(F.col("n") > config.max_observations, "too_many")
                .when(F.col("bad_content"), "content").when(F.col("bad_vector"), "vector")
                .when(F.col("blank_id"), "blank_id").when(F.col("repeated_id"), "repeated_id").alias("reason")))


def validate_evidence_labels(labels: DataFrame, offered: DataFrame) -> DataFrame:
    """Per request: every offered depth-0 id judged exactly once with a reason.

    ``labels(request_id, memory_id, reason)``, ``offered(request_id, memory_id, depth)``.
    """
    given = labels.groupBy("request_id", "memory_id").agg(
        F.count("*").alias("n"), F.max(S.is_blank(F.col("reason"))).alias("blank"))
    wanted = offered.groupBy("request_id", "memory_id").agg(
        F.count("*").alias("n_offered"), F.max("depth").alias("depth"))
    return (wanted.join(given, ["request_id", "memory_id"], "full_outer").groupBy("request_id").agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n_offered").isNull()).alias("unknown"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("blank")).alias("blank_reason"),
        F.count_if((F.col("n_offered") > 1) | (F.col("depth") != 0)).alias("bad_offer"))
        .withColumn("ok", (F.col("missing") + F.col("unknown") + F.col("repeated")
                           + F.col("blank_reason") + F.col("bad_offer")) == 0))


def validate_usage(settlements: DataFrame) -> DataFrame:
    """First settlement per call with its verdict.

    ``settlements(call_id, at, attempt, input_tokens, cached, writes, output, cost)``.
    """
    negative = (F.col("input_tokens") < 0) | (F.col("cached") < 0) | (F.col("writes") < 0) | (F.col("output") < 0) | (F.col("cost") < 0)
    reason = F.when(negative, "negative").when(F.col("cached") + F.col("writes") > F.col("input_tokens"), "cached exceeds input")
    judged = settlements.withColumn("reason", reason)
    columns = [c for c in judged.columns if c not in ("call_id", "at", "attempt")]
    first = F.min(F.when(F.col("reason").isNull(), F.struct("at", "attempt", *columns))).alias("f")
    return (judged.groupBy("call_id").agg(first, F.count_if(F.col("reason").isNotNull()).alias("n_invalid"))
            .select("call_id", "n_invalid", "f.*"))


def neighbourhood_dedup(members: DataFrame, work: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Status per work item: run, or deduplicated when an earlier item of the
    same run had exactly the same member set.

    ``members(run_id, work_key, memory_id)``; sets are bounded by the
    neighbourhood cap. ``saved(run_id, member_key)`` seeds the registry with
    the sets of proposals that already exist.
    """
    keys = (members.groupBy("run_id", "work_key")
            .agg(F.to_json(F.array_sort(F.collect_set("memory_id"))).alias("member_key")))
    ordered = work.select("run_id", "work_key", "ordinal").join(keys, ["run_id", "work_key"])
    # the first item per set is found by a combining aggregate, so a set shared
    # by a third of all items never meets in one window
    first = ordered.groupBy("run_id", "member_key").agg(F.min(F.struct("ordinal", "work_key")).alias("first"))
    if saved is not None:
        seen = saved.select("run_id", "member_key").distinct().withColumn("seen", F.lit(True))
        first = first.join(seen, ["run_id", "member_key"], "left")
    else:
        first = first.withColumn("seen", F.lit(None).cast("boolean"))
    winners = first.filter(F.col("seen").isNull()).select(
        "run_id", F.col("first.work_key").alias("work_key"), F.lit(True).alias("won"))
    return (ordered.join(winners, ["run_id", "work_key"], "left")
            .withColumn("status", F.when(F.col("won"), "run").otherwise("deduplicated")).drop("won"))
