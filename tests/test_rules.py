"""Proposal rules, planning, ledgers and evaluation on hand-written cases."""

import itertools
import random
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from memstrata.config import EngineConfig
from memstrata.operators import accounting, evaluation, proposals
from memstrata.plans import daily_report, work

KEY = "run_id long, work_key string, proposal_index int, "


def ts(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def test_first_outcome_stays(spark):
    rows = [(1, "w", 0, "2026-01-01", 0, "appended"), (1, "w", 0, "2026-01-02", 1, "rejected"), (1, "w", 1, "2026-01-02", 0, "already_exists")]
    for order in itertools.permutations(rows):
        df = ts(spark.createDataFrame(list(order), KEY + "at string, attempt int, outcome string"), "at")
        assert {r.proposal_index: r.outcome for r in proposals.first_outcomes(df).collect()} == {0: "appended", 1: "already_exists"}


def test_relation_outcome_sequence(spark):
    mem = spark.createDataFrame([("a", 1, 0, True), ("b", 2, 0, True)], "id string, seq long, dream_revision long, sealed boolean")
    runs = spark.createDataFrame([(5, 10)], "id long, memory_high_water long")
    rel = spark.createDataFrame([], "memory_id string, related_memory_id string, kind string")
    rows = [(5, "w", 0, "a"), (5, "w", 1, "a"), (5, "w", 2, "unknown")]
    df = spark.createDataFrame(rows, KEY + "memory_id string").select(
        "*", F.lit("b").alias("related_memory_id"), F.lit("positive").alias("kind"), F.lit(None).cast("string").alias("reason"),
        F.lit(0).alias("ordinal"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    new, outcomes = proposals.apply_relations(df, mem, rel, runs)
    assert {r.proposal_index: r.outcome for r in outcomes.collect()} == {0: "appended", 1: "already_exists", 2: "rejected"}
    assert new.count() == 1
    _again, after = proposals.apply_relations(df, mem, new.select("memory_id", "related_memory_id", "kind"), runs, outcomes)
    assert {r.proposal_index: r.outcome for r in after.collect()} == {0: "appended", 1: "already_exists", 2: "rejected"}


def test_abstraction_reasons_follow_parent_order(spark):
    mem = spark.createDataFrame([("a", 1, 0, 0), ("b", 2, 0, 0), ("c", 3, 0, 0), ("d", 4, 1, 1), ("late", 99, 0, 0)],
                                "id string, seq long, depth int, dream_revision long").withColumn("sealed", F.lit(True))
    roots = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3"), ("late", "s4")], "memory_id string, source_id string")
    runs = spark.createDataFrame([(5, 10)], "id long, memory_high_water long")
    everyone = ["a", "b", "c", "d", "late", "gone"]
    cases = {
        "ok": ["a", "b", "c"], "few": ["a", "b"], "twice": ["a", "a", "b", "c"], "gone": ["a", "gone", "late"], "late": ["late", "gone", "a"],
        "mixed": ["a", "d", "c"], "private": ["a", "b", "zz"]}
    df = spark.createDataFrame([(5, k, 0, "text", v, everyone) for k, v in cases.items()] + [(5, "blank", 0, "  ", ["a"], everyone)],
                               KEY + "content string, derived_from array<string>, allowed array<string>")
    got = {r.work_key: r.reason for r in proposals.validate_abstractions(df, mem, roots, runs, EngineConfig()).collect()}
    assert got == {"ok": None, "few": "parents_below_base", "twice": "parents_below_base",
                   "gone": "parent_unknown", "late": "parent_not_before_run", "mixed": "parent_depths_differ",
                   "private": "parent_not_offered", "blank": "content_blank"}


def lifecycle_by_hand(steps):
    state, n = "pending", 0
    allowed = {"processing": ("pending", "failed"), "failed": ("processing",), "complete": ("processing", "complete")}
    for s in steps:
        if s != "pending" and state in allowed[s]:
            state, n = s, n + 1
    return state, n


def test_lifecycle_equals_the_state_machine(spark):
    rnd = random.Random(1)
    logs = {f"s{i}": ["pending"] + [rnd.choice(["processing", "failed", "complete", "processing"]) for _ in range(rnd.randrange(9))] for i in range(120)}
    df = spark.createDataFrame([(k, i, s) for k, v in logs.items() for i, s in enumerate(v)], "source_id string, seq int, status string")
    current, _ = work.source_lifecycle(df)
    assert {r.source_id: (r.status, r.n_valid) for r in current.collect()} == {k: lifecycle_by_hand(v) for k, v in logs.items()}


def test_due_periods_interleave_weeks(spark):
    cursors = spark.createDataFrame([("a", "2026-01-01", "2026-01-01", "2026-01-10", Decimal(1)), ("b", "2026-01-01", "2026-01-01", "2026-01-10", None)],
                                    "corpus_id string, next_day string, next_week string, today string, budget_usd decimal(38,12)").withColumns(
        {c: F.col(c).cast("date") for c in ("next_day", "next_week", "today")})
    rows = work.due_periods(cursors, "Asia/Seoul").orderBy("corpus_id", "position").collect()
    a = [(r.kind, str(r.first_day)) for r in rows if r.corpus_id == "a"]
    assert len(a) == 10 and a[7] == ("meditation", "2026-01-01") and a[6] == ("dream", "2026-01-07") and a[8] == ("dream", "2026-01-08")
    assert [r.kind for r in rows if r.corpus_id == "b"] == ["dream"] * 9


def test_budget_allows_equality(spark):
    calls = ts(spark.createDataFrame(
        [(1, "a", 0, Decimal("0.5"), Decimal("0.2"), "2026-01-01 00:00:00", "2026-01-01 00:10:00"), (1, "b", 1, Decimal("0.8"), None, "2026-01-01 02:00:00", None),
         (1, "c", 2, Decimal("0.000000000001"), None, "2026-01-02 00:00:00", None)],
        "run_id long, id string, ordinal long, reserved_usd decimal(38,12), actual_usd decimal(38,12), created_at string, completed_at string"), "created_at", "completed_at")
    got = {r.id: (r.exposure_before, r.violates) for r in accounting.budget_timeline(calls, F.lit("1").cast("decimal(38,12)")).collect()}
    assert got == {"a": (0, False), "b": (Decimal("0.2"), False), "c": (Decimal("1.0"), True)}


def test_dedup_is_exact_and_per_run(spark):
    members = [(1, "w1", "a"), (1, "w1", "b"), (1, "w2", "b"), (1, "w2", "a"), (1, "w3", "a"), (1, "w3", "c"), (2, "w4", "a"), (2, "w4", "b")]
    items = [(1, "w1", 5), (1, "w2", 2), (1, "w3", 7), (2, "w4", 0)]
    df = proposals.neighbourhood_dedup(spark.createDataFrame(members, "run_id long, work_key string, memory_id string"),
                                       spark.createDataFrame(items, "run_id long, work_key string, ordinal int"))
    assert {r.work_key: r.status for r in df.collect()} == {"w1": "deduplicated", "w2": "run", "w3": "run", "w4": "run"}


def paired(spark, rows):
    base = spark.createDataFrame(rows, "query_id string, question_type string, a boolean, b boolean")
    both = base.select("query_id", "question_type", F.explode(F.array(F.struct(F.lit("A").alias("condition"), F.col("a").alias("hit")),
                                                                     F.struct(F.lit("B").alias("condition"), F.col("b").alias("hit")))).alias("c")).select("query_id", "question_type", "c.*")
    zero = {c: F.lit(0).cast("decimal(38,12)") for c in ("shared_usd", "shared_reserved", "condition_usd", "condition_reserved")}
    return both.withColumns(zero)


def test_thresholds_are_inclusive(spark):
    rows = [(f"t{i}", "temporal-reasoning", i < 10, i < 5) for i in range(100)] + [(f"m{i}", "multi-session", i < 20, i < 40) for i in range(400)]
    metrics = paired(spark, rows)
    out = evaluation.benchmark_summary(metrics, spark.createDataFrame([("t0",)], "query_id string"), 500).first()
    assert out.complete and out.meets_threshold and out.difference_pp == 3 and (out.gains, out.regressions, out.no_gold) == (20, 5, 499)
    cats = {r.question_type: (r.difference_pp, r.investigate) for r in evaluation.category_metrics(metrics).collect()}
    assert cats == {"temporal-reasoning": (-5, True), "multi-session": (5, False)}
    part = evaluation.benchmark_summary(metrics.filter("query_id <> 't0'"), spark.createDataFrame([("t0",)], "query_id string"), 500).first()
    assert not part.complete and part.meets_threshold is None


def test_micro_verdicts(spark):
    none = spark.createDataFrame([], "query_id string, depth int, gold_id string")
    above = spark.createDataFrame([("q0", 1, "g")], "query_id string, depth int, gold_id string")
    win, loss = paired(spark, [("q0", "t", False, True), ("q1", "t", True, True)]), paired(spark, [("q0", "t", True, False), ("q1", "t", True, True)])
    verdict = lambda m, x, n: evaluation.micro_verdict(m, x, n).first().verdict
    assert verdict(win, above, 2) == "PROMISING" and verdict(win, none, 2) == "INCONCLUSIVE"
    assert verdict(loss, above, 2) == "REGRESSION" and verdict(loss, above, 8) == "INCONCLUSIVE"
    assert verdict(win, above, 1) == "INCONCLUSIVE"
    assert evaluation.micro_verdict(win, above, 2, status="stopped").first().verdict == "INCONCLUSIVE"


def test_samples_refuse_bad_input(spark):
    few = spark.createDataFrame([(f"q{i}", "t") for i in range(7)], "query_id string, question_type string")
    with pytest.raises(ValueError):
        evaluation.round_robin_sample(few, [])
    with pytest.raises(ValueError):
        evaluation.round_robin_sample(few.unionByName(few), [])
    sessions = spark.createDataFrame([("q", f"s{i}", i, i, i == 1) for i in range(5)] + [("p", "s1", 1, 1, True)],
                                     "question_id string, session_id string, ts long, ordinal int, is_gold boolean").withColumn("ts", F.timestamp_seconds("ts"))
    gold = spark.createDataFrame([("q", "s1"), ("q", "s1"), ("p", "s9")], "question_id string, session_id string")
    kept, errors = evaluation.even_chronological_sample(sessions, gold=gold)
    assert {tuple(r) for r in errors.collect()} == {("q", "duplicate gold session"), ("p", "missing gold session")} and kept.count() == 0


def test_a_new_space_takes_its_first_dimension(spark):
    from memstrata.sources import vectors
    stored = spark.createDataFrame([("m0", "old", 1, [1.0])], "memory_id string, space string, dimensions int, vector array<float>")
    new = spark.createDataFrame([("m1", "new", 2, [1.0, 2.0], 0), ("m2", "new", 1, [1.0], 1), ("m3", "old", 2, [1.0, 1.0], 2), ("m4", "old", 1, [3.0], 3)],
                                "memory_id string, space string, dimensions int, vector array<float>, ordinal int")
    merged, rejected = vectors.upsert(stored, new)
    assert {r.memory_id for r in merged.collect()} == {"m0", "m1", "m4"} and {r.memory_id for r in rejected.collect()} == {"m2", "m3"}


def test_even_sample_positions(spark):
    rows = [("q", f"s{i:02d}", f"2026-01-{i + 1:02d}", i, i in (0, 30)) for i in range(31)]
    df = ts(spark.createDataFrame(rows, "question_id string, session_id string, ts string, ordinal int, is_gold boolean"), "ts")
    kept, errors = evaluation.even_chronological_sample(df)
    others = [f"s{i:02d}" for i in range(1, 30)]
    want = sorted({others[i * 28 // 7] for i in range(8)} | {"s00", "s30"})
    assert [r.session_id for r in kept.orderBy("position").collect()] == want and errors.count() == 0
    _kept, bad = evaluation.even_chronological_sample(df.unionByName(df))
    assert [r.problem for r in bad.collect()].count("duplicate session") == 1


def test_nearest_rank(spark):
    for n in (1, 2, 9, 10, 11, 100):
        values = [random.Random(n).randrange(20) for _ in range(n)]
        row = daily_report.nearest_rank(spark.createDataFrame([("g", v) for v in values], "g string, v long"), ["g"], "v").first()
        s = sorted(values)
        assert (row.n, row.p50, row.p90, row.max) == (n, s[-(-n * 5 // 10) - 1], s[-(-n * 9 // 10) - 1], s[-1])


def test_late_settlement_changes_only_its_day(spark):
    report = lambda usd: spark.createDataFrame([("2026-01-01", usd, None), ("2026-01-02", 1, 5)], "date string, usd int, n int").withColumn("date", F.col("date").cast("date"))
    prior = daily_report.fingerprints(report(3))
    day = lambda t: F.lit(t).cast("date")
    changed = daily_report.changed_days(report(4), prior, day("2026-01-01"), day("2026-01-03"))
    assert [str(r.date) for r in changed.collect()] == ["2026-01-01"]


def test_ancestry_errors(spark):
    m = spark.createDataFrame([("a", 0, "s1"), ("b", 1, None), ("c", 1, None), ("d", 3, None)], "id string, depth int, source_ref string")
    d = spark.createDataFrame([("b", "a"), ("b", "gone"), ("d", "b")], "child_id string, parent_id string")
    got = {(r.memory_id, r.problem) for r in evaluation.ancestry_errors(m, d, spark.createDataFrame([("s2",)], "source_id string")).collect()}
    assert got == {("a", "unmapped source"), ("b", "missing parent"), ("c", "abstraction without parents"), ("d", "parent is not one level below")}


def test_high_water_inside_a_day(spark):
    ev = ts(spark.createDataFrame([(1, "2026-01-01 05:00:00"), (2, "2026-01-01 15:00:00"), (3, "2026-01-01 16:00:00"), (4, "2026-01-03 00:00:00")], "seq long, at string"), "at")
    runs = ts(spark.createDataFrame([(1, "2026-01-01 15:30:00"), (2, "2026-01-03 00:00:00"), (3, "2026-01-01 00:00:00"), (4, "2026-02-01 00:00:00")], "id long, period_end string"), "period_end")
    got = {r.id: r.h for r in work.with_high_water(runs, ev, "at", "h").collect()}
    assert got == {1: 2, 2: 3, 3: 0, 4: 4}


def test_daily_work_travels_without_its_keys(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1, 5)
    memories = spark.createDataFrame([("m1", 1, 0, at, True), ("m2", 2, 0, at, True)], "id string, seq long, depth int, created_at timestamp, sealed boolean")
    runs = spark.createDataFrame([(1, "dream", datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), 2, 0, 0)],
                                 "id long, kind string, period_start timestamp, period_end timestamp, memory_high_water long, relation_high_water long, recall_high_water long")
    recalls = spark.createDataFrame([], "seq long, memory_id string, recalled_at timestamp")
    plan = work.dream_plan(memories, recalls, runs)
    assert [tuple(r) for r in plan.orderBy("ordinal").collect()] == [
        (1, "assimilate:m1", "assimilation", "m1", 0), (1, "assimilate:m2", "assimilation", "m2", 1),
        (1, "abstract:m1", "consolidation", "m1", 2), (1, "abstract:m2", "consolidation", "m2", 3)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("assimilate:") < text.index("Join") and text.count("assimilate:") == 1
