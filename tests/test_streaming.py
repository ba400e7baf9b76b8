"""Streaming jobs over several batches, with files that come out of order."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from memstrata.session import utc_session
from memstrata.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def files(spark, folder, schema, batches):
    """One file per batch, read one at a time in the order of their writing."""
    import time
    utc_session(spark)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, write, folder):
    stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", str(folder)).start().awaitTermination()


def test_budget_marks_calls_that_come_late(spark, tmp_path):
    schema = "run_id long, id string, ordinal long, at timestamp, step int, amount decimal(38,12)"
    at = lambda h: T0 + dt.timedelta(hours=h)
    row = lambda i, h, amount: (1, f"c{i}", i, at(h), 1, Decimal(amount))
    batches = [[row(1, 1, "0.1"), row(2, 5, "0.1")], [row(3, 3, "0.1")], [row(4, 9, "0.1")]]
    stream = files(spark, tmp_path / "in", schema, batches)
    run(stream, jobs.budget_alert(str(tmp_path / "out"), "0.25"), tmp_path / "cp")
    got = {r.id: (float(r.exposure_before), r.violates, r.late) for r in spark.read.schema(jobs.ALERT_SCHEMA)
           .option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "alerts")).collect()}
    assert got == {"c1": (0.0, False, False), "c2": (0.1, False, False), "c3": (0.2, True, True), "c4": (0.3, True, False)}


def test_status_keeps_the_order_within_and_across_batches(spark, tmp_path):
    jobs.use_rocksdb(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)       # several chunks for one source
    try:
        schema = "source_id string, seq long, status string"
        first = [("s", 4, "processing"), ("s", 2, "processing"), ("s", 3, "failed"), ("s", 1, "pending"), ("t", 1, "complete")]
        batches = [first, [("s", 6, "complete"), ("s", 5, "complete")], [("t", 2, "processing"), ("s", 7, "failed")]]
        stream = jobs.source_status(files(spark, tmp_path / "in", schema, batches))
        out = str(tmp_path / "out")
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
        got = {(r.source_id, r.seq): (r.status, r.valid) for r in spark.read.parquet(out).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {("s", 2): ("processing", True), ("s", 3): ("failed", True), ("s", 4): ("processing", True), ("s", 5): ("complete", True),
                   ("s", 6): ("complete", True), ("s", 7): ("complete", False), ("t", 1): ("pending", False), ("t", 2): ("processing", True)}


def test_late_settlements_reach_their_call(spark, tmp_path):
    calls = [(f"c{i}", 1, Decimal(1), T0 + dt.timedelta(hours=i)) for i in range(4)]
    spark.createDataFrame(calls, "id string, run_id long, reserved_usd decimal(38,12), created_at timestamp").write.parquet(str(tmp_path / "calls"))
    settled = lambda i, h: (f"c{i}", Decimal("0.5"), T0 + dt.timedelta(hours=i + h))
    stream = files(spark, tmp_path / "in", "id string, actual_usd decimal(38,12), completed_at timestamp", [[settled(0, 1), settled(1, 30)], [settled(2, 2)], [settled(3, 900)]])
    run(stream, jobs.late_settlements(str(tmp_path / "calls"), str(tmp_path / "out")), tmp_path / "cp")
    late = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).filter(F.col("actual_usd").isNotNull())
    assert sorted(r.id for r in late.collect()) == ["c1", "c3"]


def test_cost_days_are_recomputed_from_pruned_scans(spark, tmp_path):
    utc_session(spark)
    calls = [(f"c{i}", T0 + dt.timedelta(hours=7 * i), Decimal(i)) for i in range(40)]
    spark.createDataFrame(calls, "id string, created_at timestamp, actual_usd decimal(38,12)").write.parquet(str(tmp_path / "calls"))
    write = jobs.daily_cost_upsert(str(tmp_path), "Asia/Seoul")
    write(spark.createDataFrame(calls[:3], "id string, created_at timestamp, actual_usd decimal(38,12)"), 0)
    write(spark.createDataFrame(calls[20:22], "id string, created_at timestamp, actual_usd decimal(38,12)"), 1)
    write(spark.createDataFrame([], "id string, created_at timestamp, actual_usd decimal(38,12)"), 2)
    got = {r.date: r.api_calls for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    local = [(c[1] + dt.timedelta(hours=9)).date() for c in calls]
    touched = {local[i] for i in (0, 1, 2, 20, 21)}
    assert got == {d: local.count(d) for d in touched}


LOG = "id string, run_id long, step int, at timestamp, amount decimal(38,12)"


def settlement_batches():
    at = lambda h: T0 + dt.timedelta(hours=h)
    call = lambda i, h: (f"c{i}", 1, 1, at(h), Decimal(1))
    paid = lambda i, h: (f"c{i}", 1, 0, at(h), Decimal("0.25"))
    return [[call(1, 0), call(2, 0), call(3, 1), paid(1, 1)], [paid(2, 30), call(4, 30), (None, 1, 1, at(30), Decimal(9))],
            [paid(2, 60), call(5, 59), paid(6, 59.5)], [call(6, 59.5), paid(1, 61), paid(3, 60.5), call(7, 90)]]


SETTLED = {("c1", "settled", False), ("c2", "late", False), ("c3", "open", False), ("c3", "late", True), ("c4", "open", False),
           ("c5", "open", False), ("c6", "settled", False)}


def test_settlements_of_any_lateness_find_their_call(spark, tmp_path):
    jobs.use_rocksdb(spark)
    stream = jobs.settlement_ledger(files(spark, tmp_path / "in", LOG, settlement_batches()), 7200)
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(out).collect()
    got = sorted((r.id, r.state, r.was_open) for r in rows)
    assert got == sorted(SETTLED)
    assert {r.actual_usd for r in rows if r.state != "open"} == {Decimal("0.25")}


def test_a_batch_that_failed_after_its_write_is_repeated(spark, tmp_path):
    import pytest
    jobs.use_rocksdb(spark)
    stream = jobs.settlement_ledger(files(spark, tmp_path / "in", LOG, settlement_batches()), 7200)
    days, seen = jobs.corrected_days(str(tmp_path / "days"), "UTC"), []

    def write(batch, number):
        days(batch, number)
        seen.append(number)
        if seen.count(number) == 1 and number in (1, 2):
            raise RuntimeError("lost after the write")
    for _ in range(2):
        with pytest.raises(Exception, match="lost after the write"):
            run(stream, write, tmp_path / "cp")
    run(stream, write, tmp_path / "cp")
    assert seen[:5] == [0, 1, 1, 2, 2]
    got = {str(r.date): (r.settled, r.late, r.open, r.actual_usd) for r in spark.read.parquet(str(tmp_path / "days" / str(max(seen)))).collect()}
    assert got == {"2024-01-01": (1, 2, 0, Decimal("0.75")), "2024-01-02": (0, 0, 1, None), "2024-01-03": (1, 0, 1, Decimal("0.25"))}


def test_calls_of_one_bucket_do_not_meet(spark, tmp_path):
    jobs.use_rocksdb(spark)
    # a run number that a double does not hold, and none
    run_of = {"c1": 2 ** 60 + 1, "c2": None}
    batches = [[(i, run_of.get(i, 1), *rest) for i, _, *rest in rows] for rows in settlement_batches()]
    stream = files(spark, tmp_path / "in", LOG, batches)
    for buckets in (1, 3):
        out = str(tmp_path / f"out{buckets}")
        (jobs.settlement_ledger(stream, 7200, buckets=buckets).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / f"cp{buckets}")).trigger(availableNow=True).start().awaitTermination())
        rows = spark.read.parquet(out).collect()
        assert sorted((r.id, r.state, r.was_open) for r in rows) == sorted(SETTLED)
        assert all(r.run_id == run_of.get(r.id, 1) for r in rows) and {r.reserved_usd for r in rows} == {Decimal(1)}


def test_sources_of_one_bucket_do_not_meet(spark, tmp_path):
    jobs.use_rocksdb(spark)
    batches = [[("s", 1, "processing"), ("t", 2, "complete"), (None, 3, "processing")], [("s", 4, "complete"), ("t", 5, "processing"), (None, 6, "failed")]]
    stream = jobs.source_status(files(spark, tmp_path / "in", "source_id string, seq long, status string", batches), buckets=1)
    out = str(tmp_path / "out")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    got = {(r.source_id, r.seq): (r.status, r.valid) for r in spark.read.parquet(out).collect()}
    assert got == {("s", 1): ("processing", True), ("t", 2): ("pending", False), (None, 3): ("processing", True),
                   ("s", 4): ("complete", True), ("t", 5): ("processing", True), (None, 6): ("failed", True)}
