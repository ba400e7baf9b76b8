"""Incremental report refresh against a full rebuild."""

import pytest

from pyspark.sql import functions as F

from memstrata.operators import graph
from memstrata.plans import report_refresh as refreshing
from memstrata.session import durable
from memstrata.sources.corpus import Corpus
from suite.aggregates import ZONE
from suite.sources import ledger_now


def day(text):
    return F.lit(text).cast("date")


def content(report):
    return {r.date: r.j for r in report.select("date", F.to_json(F.struct(*sorted(report.columns)),
                                                                 {"ignoreNullFields": "false"}).alias("j")).collect()}


few = lambda c, n: F.crc32(c) % n == 0
CASES = {
    "operations": lambda t: t.operations.withColumn("parent_id", F.when(few("id", 40), None).otherwise(F.col("parent_id")))
                                        .withColumn("charged_run_id", F.when(few("id", 300), F.lit(3)).otherwise(F.col("charged_run_id"))).filter(~few("id", 90)),
    "sources": lambda t: t.sources.withColumn("status", F.when(few("id", 40), "pending").otherwise(F.col("status"))),
    "memories": lambda t: t.memories.filter(~few("id", 90)),
    "calls": lambda t: t.calls.withColumn("run_id", F.when(few("id", 200), F.lit(7)).otherwise(F.col("run_id"))),
    "links": lambda t: t.links.filter(~few("api_call_id", 200)),
    "runs": lambda t: t.runs.withColumn("started_at", F.when(F.col("id") == 5, F.col("started_at") + F.expr("interval 3 days")).otherwise(F.col("started_at"))),
    "run_work": lambda t: t.run_work.filter(~few("work_key", 200)),
    "results": lambda t: t.results.withColumn("outcome", F.when(few("activity_id", 60), "rejected").otherwise(F.col("outcome"))),
}


@pytest.fixture(scope="module")
def full(spark):
    now = ledger_now(Corpus.of(spark, "/root/testdata/sf0.001"))
    now = now.with_tables(**{name: durable(getattr(now, name)) for name in CASES})
    roots = durable(graph.component_roots(now.operations))
    return now, roots, content(refreshing.build_report(now, roots, ZONE, day("2024-01-10"), day("2024-01-28")))


@pytest.mark.parametrize("names", [("operations", "links", "sources"), ("memories", "calls", "runs", "run_work", "results")])
def test_refresh_equals_the_full_rebuild(spark, full, names):
    now, roots_now, want = full
    before = now.with_tables(**{name: durable(CASES[name](now)) for name in names})
    roots = durable(graph.component_roots(before.operations))
    prior = durable(refreshing.build_report(before, roots, ZONE, day("2024-01-10"), day("2024-01-28")))
    changes = {name: refreshing.changed_rows(getattr(before, name), getattr(now, name)) for name in names}
    got, roots_after, days = refreshing.refresh(prior, roots, now, changes, ZONE, day("2024-01-10"), day("2024-01-28"), day("2024-01-28"))
    assert content(got) == want
    assert {tuple(r) for r in roots_after.collect()} == {tuple(r) for r in roots_now.select(*roots_after.columns).collect()}
    old = content(prior)
    assert {r.date for r in days.collect() if r.changed} == {d for d in old.keys() | want.keys() if old.get(d) != want.get(d)}


def test_nothing_changed_rebuilds_only_the_days_closed_since(spark, full):
    now, roots, _ = full
    prior = durable(refreshing.build_report(now, roots, ZONE, day("2024-01-10"), day("2024-01-20")))
    _, _, days = refreshing.refresh(prior, roots, now, {}, ZONE, day("2024-01-10"), day("2024-01-20"), day("2024-01-22"))
    assert {(str(r.date), r.changed) for r in days.collect()} == {("2024-01-20", True), ("2024-01-21", True)}


def test_only_rows_that_may_differ_are_compared_whole(spark, monkeypatch):
    import datetime
    from memstrata.plans import report_refresh
    at = lambda us: datetime.datetime(2024, 1, 1, 0, 0, 0, us)
    schema = "id string, at timestamp, x double, ids array<string>"
    same = [(f"s{i}", at(i), float(i), [None, "a"]) for i in range(40)] + [(None, None, None, None)] * 2
    old = [("us", at(1), 1.0, []), ("twice", at(0), 1.0, None), ("twice", at(0), 1.0, None), ("zero", at(0), 0.0, ["a", None]), ("array", at(0), 1.0, ["a", None]), ("gone", None, None, None)]
    new = [("us", at(2), 1.0, []), ("twice", at(0), 1.0, None), ("zero", at(0), -0.0, ["a", None]), ("array", at(0), 1.0, [None, "a"]), ("new", None, float("nan"), None)]
    frames = [spark.createDataFrame(same + rows, schema) for rows in (old, new)]
    want = frames[0].exceptAll(frames[1]).unionByName(frames[1].exceptAll(frames[0]))
    seen = []
    kind = type(frames[0])
    whole = kind.exceptAll
    monkeypatch.setattr(kind, "exceptAll", lambda self, other: (seen.append(self.count()), whole(self, other))[1])
    got = report_refresh.changed_rows(*frames)
    monkeypatch.undo()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert seen and max(seen) <= len(old)


def test_owners_go_to_the_links_of_the_calls(spark):
    from memstrata.plans import daily_report
    calls = spark.createDataFrame([("c1", 1), ("c2", 2), ("c2", 3), ("c3", 4), (None, 5)], "id string, n int")
    links = spark.createDataFrame([("c1", "o1", "x"), ("c2", "o2", "y"), ("c2", None, "z"), (None, "o1", "w"), ("c4", "o1", "v")], "api_call_id string, activity_id string, settings_json string")
    ops = spark.createDataFrame([("o1", "recall", "k", 1), ("o1", "remember", None, None), ("o3", "recall", "k", 1), (None, "recall", "k", 1)], "id string, kind string, work_key string, run_id int")
    got = daily_report.attribute_calls(calls, links, ops)
    owner = ops.toDF("activity_id", "parent_kind", "parent_work_key", "parent_run_id")
    want = daily_report.linked_calls(calls, links).join(owner, "activity_id", "left")
    assert got.columns == want.columns == ["activity_id", "id", "n", "settings_json", "parent_kind", "parent_work_key", "parent_run_id"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
