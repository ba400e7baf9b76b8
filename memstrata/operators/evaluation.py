"""Retrieval quality: ancestry to sessions, hits, coverage, paired summaries, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import USD
from ..session import broadcast_measured, durable, numbered, side_by_side
from . import graph

TOP = 5


# ---- ancestry -----------------------------------------------------------------

def source_session_map(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_id, session_id) by content, and the source ids that occur twice."""
    ids = sessions.select(S.content_id(F.col("raw")).alias("source_id"), "session_id")
    repeated = ids.groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 1")
    return ids, repeated


def session_ancestry(roots: DataFrame, mapping: DataFrame) -> DataFrame:
    """(memory_id, session_id) for every memory, through its distinct source roots."""
    return roots.join(mapping, "source_id").select("memory_id", "session_id").distinct()


def ancestry_errors(memories: DataFrame, derived_from: DataFrame, mapping: DataFrame) -> DataFrame:
    """(memory_id, problem): what makes ancestry unusable.

    Parents strictly one level below exclude cycles, so a cycle shows up as a
    level violation.
    """
    ids = memories.select(F.col("id").alias("parent_id"), F.col("depth").alias("parent_depth"))
    child = memories.select(F.col("id").alias("child_id"), F.col("depth").alias("child_depth"))
    edges = derived_from.join(child, "child_id").join(ids, "parent_id", "left")
    missing = edges.filter(F.col("parent_depth").isNull()).select(F.col("child_id").alias("memory_id"), F.lit("missing parent").alias("problem"))
    level = edges.filter(F.col("parent_depth") != F.col("child_depth") - 1).select(
        F.col("child_id").alias("memory_id"), F.lit("parent is not one level below").alias("problem"))
    orphan = (memories.filter("depth > 0").join(derived_from.select(F.col("child_id").alias("id")), "id", "left_anti")
              .select(F.col("id").alias("memory_id"), F.lit("abstraction without parents").alias("problem")))
    unmapped = (memories.filter("depth = 0").join(mapping.select(F.col("source_id").alias("source_ref")), "source_ref", "left_anti")
                .select(F.col("id").alias("memory_id"), F.lit("unmapped source").alias("problem")))
    return missing.unionByName(level).unionByName(orphan).unionByName(unmapped).distinct()


def overlay(*frames: DataFrame) -> DataFrame:
    """One row per id, the frame listed first wins."""
    tagged = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)]
    everything = tagged[0]
    for frame in tagged[1:]:
        everything = everything.unionByName(frame)
    columns = [c for c in everything.columns if c not in ("id", "priority")]
    return (everything.groupBy("id").agg(F.min_by(F.struct(*columns), "priority").alias("r"))
            .select("id", "r.*"))


def gold_matches(retrieved: DataFrame, memories: DataFrame, derived_from: DataFrame, gold: DataFrame,
                 depth: int) -> DataFrame:
    """(query_id, memory_id, gold_id): gold depth-0 ancestors of each retrieved memory, itself at depth 0."""
    starts = retrieved.select(F.col("memory_id").alias("start"), "memory_id").distinct()
    closure = graph.ancestor_closure(starts, derived_from, depth).join(
        memories.filter("depth = 0").select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return (retrieved.select("query_id", F.col("memory_id").alias("start")).distinct()
            .join(closure, "start").join(gold.select("query_id", "memory_id").distinct(), ["query_id", "memory_id"])
            .select("query_id", F.col("start").alias("memory_id"), F.col("memory_id").alias("gold_id")))


# ---- per-question metrics -------------------------------------------------------

def retrieval_metrics(candidates: DataFrame, selected: DataFrame, sessions: DataFrame, gold: DataFrame,
                      judged: DataFrame) -> DataFrame:
    """Flags per (condition, query_id).

    ``candidates`` and ``selected`` hold (condition, query_id, rank,
    memory_id); ``sessions`` is the memory ancestry, ``gold`` (query_id,
    session_id), ``judged`` (condition, query_id, correct) lists every pair.
    """
    key = ["condition", "query_id"]

    def hit(ranked: DataFrame, name: str) -> DataFrame:
        return (ranked.select(*key, "memory_id").join(sessions, "memory_id")
                .join(gold, ["query_id", "session_id"], "left_semi")
                .select(*key).distinct().withColumn(name, F.lit(True)))

    flags = (judged.join(hit(selected.filter(F.col("rank") <= TOP), "hit"), key, "left")
             .join(hit(candidates, "in_candidates"), key, "left")
             .withColumn("hit", F.coalesce("hit", F.lit(False)))
             .withColumn("in_candidates", F.coalesce("in_candidates", F.lit(False))))
    return (flags.withColumn("candidate_failure", ~F.col("hit") & ~F.col("in_candidates"))
            .withColumn("selection_failure", ~F.col("hit") & F.col("in_candidates"))
            .withColumn("answer_failure", F.col("hit") & ~F.col("correct")))


def paired_outcome(metrics: DataFrame, first: str = "A", second: str = "B") -> DataFrame:
    """gain and regression per question from the two conditions."""
    side = metrics.groupBy("query_id").agg(
        F.max(F.when(F.col("condition") == first, F.col("hit"))).alias("first_hit"),
        F.max(F.when(F.col("condition") == second, F.col("hit"))).alias("second_hit"))
    return (side.withColumn("gain", ~F.col("first_hit") & F.col("second_hit"))
            .withColumn("regression", F.col("first_hit") & ~F.col("second_hit")))


def evidence_coverage(matches: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """Coverage per question: ``matches(query_id, scope, gold_id)`` with scope selected or candidate."""
    covered = (matches.select("query_id", "scope", "gold_id").distinct()
               .groupBy("query_id").agg(F.count_if(F.col("scope") == "selected").alias("n_selected"),
                                        F.count_if(F.col("scope") == "candidate").alias("n_candidate")))
    n_gold = gold.groupBy("query_id").agg(F.countDistinct("memory_id").alias("n_gold"))
    out = (questions.select("query_id").join(n_gold, "query_id", "left").join(covered, "query_id", "left")
           .fillna(0, ["n_gold", "n_selected", "n_candidate"]))
    none = F.col("n_gold") == 0
    share = lambda c: F.when(none, F.lit(0).cast("decimal(20,10)")).otherwise(
        (F.col(c).cast("decimal(10,0)") / F.when(none, F.lit(1)).otherwise(F.col("n_gold")).cast("decimal(10,0)")).cast("decimal(20,10)"))
    return (out.withColumn("hit", F.col("n_selected") > 0).withColumn("candidate_hit", F.col("n_candidate") > 0)
            .withColumn("selected_share", share("n_selected")).withColumn("candidate_share", share("n_candidate"))
            .withColumn("all_selected", ~none & (F.col("n_selected") == F.col("n_gold")))
            .withColumn("all_candidates", ~none & (F.col("n_candidate") == F.col("n_gold")))
            .withColumn("extraction_failure", none)
            .withColumn("candidate_failure", ~none & (F.col("n_candidate") == 0))
            .withColumn("selection_failure", ~none & (F.col("n_candidate") > 0) & (F.col("n_selected") == 0)))


def ranked_gold_annotation(rankings: DataFrame, sessions: DataFrame, gold: DataFrame) -> DataFrame:
    """Every ranked id with marker gold, other or provenance-unavailable."""
    reachable = sessions.select("memory_id").distinct().withColumn("known", F.lit(True))
    pairs = (rankings.select("query_id", "memory_id").distinct().join(sessions, "memory_id")
             .join(gold, ["query_id", "session_id"], "left_semi").select("query_id", "memory_id").distinct()
             .withColumn("is_gold", F.lit(True)))
    return (rankings.join(reachable, "memory_id", "left").join(pairs, ["query_id", "memory_id"], "left")
            .withColumn("marker", F.when(F.col("known").isNull(), "provenance-unavailable")
                        .when(F.col("is_gold"), "gold").otherwise("other")).drop("known", "is_gold"))


# ---- summaries --------------------------------------------------------------------

MORPHOLOGY = ("sources", "depth0", "depth1", "depth2_plus", "positive_relations",
              "negative_relations", "dream_memories", "meditation_memories")


def condition_summary(metrics: DataFrame) -> DataFrame:
    """One row per condition; unanswered and gold-free questions stay in the denominator.

    ``metrics`` carries the flags, costs and morphology of every (condition, query).
    """
    n = F.count("*")
    total = lambda c: F.sum(c).cast(USD)
    return metrics.groupBy("condition").agg(
        n.alias("questions"), F.count_if("hit").alias("hits"), S.rate(F.count_if("hit"), n).alias("recall_at_5"),
        F.count_if("correct").alias("correct_answers"), S.rate(F.count_if("correct"), n).alias("accuracy"),
        total(S.usd_add(F.col("shared_usd"), F.col("condition_usd"))).alias("attributed_usd"),
        total(S.usd_add(F.col("shared_reserved"), F.col("condition_reserved"))).alias("reserved_usd"),
        total("condition_usd").alias("condition_usd"),
        F.sum("recall_tokens").alias("recall_tokens"), S.rate(F.sum("recall_tokens"), n).alias("mean_recall_tokens"),
        F.count_if("candidate_failure").alias("candidate_failures"),
        F.count_if("selection_failure").alias("selection_failures"),
        F.count_if("answer_failure").alias("answer_failures"),
        *[F.sum(c).alias(c) for c in MORPHOLOGY],
        S.rate(F.sum("depth0"), F.sum("sources")).alias("depth0_per_source"))


def benchmark_summary(metrics: DataFrame, gold: DataFrame, expected: int, full: int = 500) -> DataFrame:
    """The overall row. A question with two results of one condition is an error. Shared cost counts once; a subset never gets the threshold verdict."""
    has_gold = gold.select("query_id").distinct().withColumn("has_gold", F.lit(True))
    per_question = metrics.groupBy("query_id").agg(
        F.max(F.when(F.col("condition") == "A", F.col("hit"))).alias("a"),
        F.max(F.when(F.col("condition") == "B", F.col("hit"))).alias("b"),
        F.max("shared_usd").alias("shared_usd"), F.max("shared_reserved").alias("shared_reserved"),
        F.sum("condition_usd").alias("both_usd"), F.sum("condition_reserved").alias("both_reserved"),
        F.greatest(F.count_if(F.col("condition") == "A"), F.count_if(F.col("condition") == "B")).alias("results"))
    joined = per_question.join(has_gold, "query_id", "left")
    n = F.count("*")
    out = joined.agg(
        F.when(F.max("results") > 1, F.raise_error(F.lit("duplicate question")).cast("long")).otherwise(n).alias("completed_questions"),
        S.rate(F.count_if("a"), n).alias("ra"), S.rate(F.count_if("b"), n).alias("rb"),
        F.count_if(F.col("has_gold").isNull()).alias("no_gold"),
        F.count_if(S.abstention_flag(F.col("query_id"))).alias("abstentions"),
        F.count_if(~F.col("a") & F.col("b")).alias("gains"), F.count_if(F.col("a") & ~F.col("b")).alias("regressions"),
        F.sum("shared_usd").cast(USD).alias("shared_usd"),
        F.sum(S.usd_add(F.col("shared_usd"), F.col("both_usd"))).cast(USD).alias("actual_usd"),
        F.sum(S.usd_add(F.col("shared_reserved"), F.col("both_reserved"))).cast(USD).alias("reserved_usd"))
    complete = (F.lit(expected) == full) & (F.col("completed_questions") == full)
    pp = S.percentage_points(F.col("rb") - F.col("ra"))
    return (out.withColumn("expected_questions", F.lit(expected).cast("long")).withColumn("complete", complete)
            .withColumn("difference_pp", pp)
            .withColumn("meets_threshold", F.when(complete, F.col("difference_pp") >= 3)).drop("ra", "rb"))


def category_metrics(metrics: DataFrame) -> DataFrame:
    """Per question type; both bounds of the alarm are inclusive."""
    a, b = F.count_if((F.col("condition") == "A") & F.col("hit")), F.count_if((F.col("condition") == "B") & F.col("hit"))
    n = F.countDistinct("query_id")
    out = metrics.groupBy("question_type").agg(n.alias("questions"), S.rate(a, n).alias("first_recall"),
                                               S.rate(b, n).alias("second_recall"),
                                               S.rate((b - a) * 100, n).alias("difference_pp"))
    return out.withColumn("investigate", F.col("difference_pp") <= -5)


def micro_verdict(metrics: DataFrame, matches: DataFrame, expected: int, status: str = "complete") -> DataFrame:
    """Wins, losses, ties and the verdict. An abstraction win needs a selected
    memory above depth 0 that reaches gold. Only a complete run of exactly the
    expected questions is judged.

    ``matches(query_id, depth, gold_id)`` are the selected memories of condition B.
    """
    above = (matches.filter(F.col("depth") > 0).select("query_id").distinct()
             .withColumn("by_abstraction", F.lit(True)))
    side = paired_outcome(metrics).join(above, "query_id", "left")
    out = side.agg(F.count("*").alias("completed"), F.count_if("gain").alias("wins"), F.count_if("regression").alias("losses"),
                   F.count_if(F.col("first_hit") & F.col("second_hit")).alias("tie_success"),
                   F.count_if(~F.col("first_hit") & ~F.col("second_hit")).alias("tie_failure"),
                   F.count_if(F.col("gain") & F.col("by_abstraction")).alias("abstraction_wins"))
    verdict = (F.when((F.col("completed") != expected) | (F.lit(status) != "complete"), "INCONCLUSIVE").when(F.col("losses") > F.col("wins"), "REGRESSION")
               .when((F.col("wins") > F.col("losses")) & (F.col("abstraction_wins") > 0), "PROMISING").otherwise("INCONCLUSIVE"))
    return out.withColumn("verdict", verdict)


def first_examples(flags: DataFrame, n: int = 3) -> DataFrame:
    """First gain and regression cases by question id."""
    kind = F.when(F.col("gain"), "gain").when(F.col("regression"), "regression")
    order = Window.partitionBy("kind").orderBy("query_id")
    return (flags.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).select("kind", "n", "query_id"))


# ---- samples ----------------------------------------------------------------------

def round_robin_sample(questions: DataFrame, excluded: list[str], n: int = 8) -> DataFrame:
    """One question per type and round, types in order, hashed order inside a type.

    Fewer than ``n`` eligible questions and a repeated id are errors. Only the first n of each
    type can be chosen, so the rank limit comes first.
    """
    repeated = questions.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").select("query_id").first()
    if repeated:
        raise ValueError(f"duplicate question {repeated.query_id}")
    digest = F.upper(F.sha2("query_id", 256))
    order = Window.partitionBy("question_type").orderBy(digest, "query_id")
    ranked = (questions.filter(~F.col("query_id").isin(excluded))
              .withColumn("round", F.row_number().over(order)).filter(F.col("round") <= n))
    chosen = durable(ranked.orderBy("round", "question_type").limit(n))
    if chosen.count() < n:
        raise ValueError(f"fewer than {n} eligible questions")
    position = Window.orderBy("round", "question_type")
    return chosen.withColumn("position", F.row_number().over(position))


def even_chronological_sample(sessions: DataFrame, cap: int = 10, gold: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept sessions, errors): all gold plus evenly spaced others in time order.

    ``sessions(question_id, session_id, ts, ordinal, is_gold)``. With
    ``gold(question_id, session_id)``, the list as it was given, a repeated
    entry and one without a session are errors as well.
    """
    numbers = sessions.groupBy("question_id").agg(
        F.count_if("is_gold").alias("n_gold"), F.count_if(~F.col("is_gold")).alias("n_other"))
    repeated = (sessions.groupBy("question_id", "session_id").agg(F.count("*").alias("n")).filter("n > 1")
                .select("question_id", F.lit("duplicate session").alias("problem")).distinct())
    many = numbers.filter(F.col("n_gold") > cap).select("question_id", F.lit("too many gold sessions").alias("problem"))
    errors = repeated.unionByName(many)
    if gold is not None:
        twice = (gold.groupBy("question_id", "session_id").agg(F.count("*").alias("n")).filter("n > 1")
                 .select("question_id", F.lit("duplicate gold session").alias("problem")).distinct())
        gone = (gold.join(sessions.select("question_id", "session_id").distinct(), ["question_id", "session_id"], "left_anti")
                .select("question_id", F.lit("missing gold session").alias("problem")).distinct())
        errors = errors.unionByName(twice).unionByName(gone)
    k = F.least(F.lit(cap) - F.col("n_gold"), F.col("n_other")).cast("int")
    places = numbers.withColumn("k", k).filter("k > 0").select("question_id", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.when(
            F.col("k") == 1, F.floor((F.col("n_other") - 1) / 2)).otherwise(
            F.floor(i * (F.col("n_other") - 1) / (F.col("k") - 1))).cast("long"))).alias("place"))
    order = [F.col("ts"), F.col("ordinal")]
    others = (numbered(sessions.filter(~F.col("is_gold")), ["question_id"], F.to_date("ts"), order, "place")
              .withColumn("place", F.col("place") - 1)
              .join(places.distinct(), ["question_id", "place"], "left_semi").drop("place"))
    kept = (sessions.filter("is_gold").unionByName(others.select(*sessions.columns))
            .join(errors.select("question_id").distinct(), "question_id", "left_anti"))
    return numbered(kept, ["question_id"], F.to_date("ts"), order), errors


def stable_session_order(sessions: DataFrame) -> DataFrame:
    return numbered(sessions, ["question_id"], F.to_date("ts"), [F.col("ts"), F.col("ordinal")])


def evaluation_cutoff(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    last = sessions.groupBy("question_id").agg(F.max("ts").alias("last_ts"))
    return questions.join(last, "question_id").select(
        "question_id", F.greatest("question_ts", "last_ts").alias("cutoff"))


def dataset_profile(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    n = questions.agg(F.count("*").alias("questions"))
    s = sessions.agg(F.count("*").alias("sessions"), F.max(S.utf16_length(F.col("raw"))).alias("max_raw_utf16"))
    return side_by_side(n, s)


# ---- containment --------------------------------------------------------------------

def containing_texts(items: DataFrame, texts: DataFrame, words: int = 4) -> DataFrame:
    """(query_id, id) where the raw text contains the item text.

    Inside an occurrence every inner word of the item is a whole word of the
    text, so a run of inner words is a join key. Candidates by key are then
    tested on the whole text. Items without enough inner words are keyed by
    the character window of their own length.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    keyed = items.select("query_id", "text", split(F.col("text")).alias("w"))
    long = keyed.filter(F.size("w") >= words + 2).select(
        "query_id", "text", F.xxhash64(*[F.get("w", F.lit(1 + k)) for k in range(words)]).alias("key"))
    n = F.size("w") - words
    grams = F.when(n >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(words)]))))
    pairs = (texts.select("id", split(F.col("raw")).alias("w")).select("id", F.explode(grams).alias("key"))
             .join(broadcast_measured(long.select("query_id", "key")), "key").select("query_id", "id").distinct())
    short = durable(keyed.filter((F.size("w") < words + 2) & (F.length("text") > 0)).select("query_id", "text"))
    for row in short.select(F.length("text").alias("n")).distinct().collect():
        # one pass per distinct short length, at most a few words long
        window = F.transform(F.sequence(F.lit(1), F.length("raw") - row.n + 1),
                             lambda i: F.substring(F.col("raw"), i, F.lit(row.n)))
        hits = (texts.filter(F.length("raw") >= row.n).select("id", F.explode(F.array_distinct(window)).alias("text"))
                .join(broadcast_measured(short.filter(F.length("text") == row.n)), "text").select("query_id", "id"))
        pairs = pairs.unionByName(hits)
    # few pairs are left: they go to the texts, which are tested where they are read
    return (texts.select("id", "raw").join(broadcast_measured(pairs), "id").join(broadcast_measured(items.select("query_id", "text")), "query_id")
            .filter(F.col("raw").contains(F.col("text"))).select("query_id", "id").distinct())


def gold_observations(items: DataFrame, observations: DataFrame) -> DataFrame:
    """(query_id, memory_id): observations whose content contains the item text."""
    return (containing_texts(items, observations.select("id", F.col("content").alias("raw")))
            .select("query_id", F.col("id").alias("memory_id")))
