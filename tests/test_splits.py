"""Positions and running sums with one key that holds a third of all rows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from memstrata.operators import accounting
from memstrata.session import dense_position, numbered, prefix_sums, running_ranges, shared_folder


def rows(n=900, seed=5):
    rnd = random.Random(seed)
    out = [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", rnd.randrange(5000), i) for i in range(n)]
    rnd.shuffle(out)
    return out


def test_numbered_is_the_row_number(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, at long, id long")
    got = {r.id: r.position for r in numbered(df, ["k"], F.floor(F.col("at") / 100), [F.col("at"), F.col("id")]).collect()}
    want = {}
    for key in {r[0] for r in data}:
        for n, r in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))):
            want[r[2]] = n + 1
    assert got == want


def test_prefix_sums_keep_the_last_digit(spark):
    data = [(k, at, i, Decimal(i) / Decimal(10**12) + Decimal(i % 7)) for k, at, i in rows(300)]
    df = spark.createDataFrame(data, "k string, at long, id long, v decimal(38,12)")
    got = {r.id: r.s for r in prefix_sums(df, ["k"], F.floor(F.col("at") / 500), [F.col("at"), F.col("id")], F.col("v"), "s").collect()}
    for key, at, i, _ in data:
        assert got[i] == sum((r[3] for r in data if r[0] == key and (r[1], r[2]) < (at, i)), Decimal(0))


def test_dense_position_is_global(spark):
    data = rows(500)
    df = spark.createDataFrame(data, "k string, at long, id long")
    got = {r.id: r.n for r in dense_position(df, ["at", "id"], [F.floor(F.col("at") / 50)], "n").collect()}
    want = {r[2]: n + 1 for n, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}
    assert got == want


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def money_log(n=600, seed=9):
    """Calls of which a third share one instant; some without run, settlement or amount."""
    import datetime as dt
    rnd = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    out = []
    for i in range(n):
        at = start if i % 3 == 0 else start + dt.timedelta(seconds=rnd.randrange(40))
        done = at + dt.timedelta(seconds=rnd.randrange(30)) if rnd.random() < 0.8 else None
        reserved = Decimal(rnd.randrange(1, 10**6)) / Decimal(10**12) + rnd.randrange(3)
        out.append((f"c{i}", rnd.choice([None, 1, 2]), i, reserved, at, reserved / 2 if done else None, done))
    rnd.shuffle(out)
    return out


CALLS = "id string, run_id long, ordinal long, reserved_usd decimal(38,12), created_at timestamp, actual_usd decimal(38,12), completed_at timestamp"


@pytest.fixture
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_global_exposure_against_a_running_sum(spark, many_ranges):
    data = [(*r[:5], r[5].quantize(Decimal("1e-12")) if r[5] is not None else None, r[6]) for r in money_log()]
    calls = spark.createDataFrame(data, CALLS)
    log = [(r[4], 1, r[2], r[0], r[3]) for r in data] + [(r[6], 0, r[2], r[0], r[5] - r[3]) for r in data if r[6] is not None]
    before, exposure = {}, Decimal(0)
    for _at, step, _n, name, amount in sorted(log):
        if step:
            before[name] = (exposure, exposure + amount)
        exposure += amount
    cap = sorted(b for _a, b in before.values())[-40]
    got = accounting.global_budget_timeline(calls, F.lit(cap).cast("decimal(38,12)")).collect()
    assert {r.id: r.exposure_before for r in got} == {k: a for k, (a, _b) in before.items()}
    assert {r.id for r in got if r.violates} == {k for k, (_a, b) in before.items() if b > cap}
    high = accounting.global_budget_breaches(calls, F.lit(cap).cast("decimal(38,12)")).collect()
    assert {r.id: r.exposure for r in high} == {k: b for k, (_a, b) in before.items() if b > cap}


def test_global_exposure_of_no_calls(spark):
    calls = spark.createDataFrame([], CALLS)
    assert accounting.global_budget_timeline(calls, F.lit(1).cast("decimal(38,12)")).count() == 0


def test_ranges_split_a_hot_instant(spark, many_ranges):
    log = accounting.exposure_log(spark.createDataFrame(money_log(), CALLS))
    rows, ranges = running_ranges(log, ["at", "step", "ordinal"], "amount")
    sizes = [r["count"] for r in rows.groupBy("__range").count().collect()]
    assert ranges.count() == len(sizes) == 4 and sum(sizes) == log.count() and max(sizes) < sum(sizes) / 2
