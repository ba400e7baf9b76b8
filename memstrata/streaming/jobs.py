"""Incremental forms of the batch jobs, as Structured Streaming queries.

Each function takes streaming frames and returns a streaming frame, except
where an upsert needs ``foreachBatch``. Sinks, triggers and checkpoint
locations belong to the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..schemas import USD
from ..session import prefix_sums

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096             # of the keys of a Python state; a running query keeps its number


def use_rocksdb(spark: SparkSession) -> None:
    """State grows with the corpus, so it belongs on disk and not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def bucketed(events: DataFrame, key: str, buckets: int) -> GroupedData:
    """Events grouped by a hash of their key: a call of Python state costs as much as thousands of rows, so many keys share one."""
    return events.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")


def source_dedup(calls: DataFrame) -> DataFrame:
    """New sources by exact content; state is one digest per source, by design unbounded."""
    return (calls.select("call_id", "at", S.content_hash(F.col("raw")).alias("content_hash"))
            .dropDuplicates(["content_hash"])
            .select(F.concat(F.lit("src_"), F.col("content_hash")).alias("id"), "content_hash",
                    S.relative_path(F.col("content_hash"), F.col("at")).alias("relative_path"),
                    F.col("at").alias("created_at"), F.lit("pending").alias("status")))


def daily_metrics(operations: DataFrame, zone_offset: str = "0 hours", lateness: str = "1 day") -> DataFrame:
    """Counts per local day and kind; append mode emits a day once it is closed.

    ``zone_offset`` is the start of the local day relative to UTC midnight.
    Zones with daylight saving use ``daily_metrics_by_date``.
    """
    return (operations.withWatermark("started_at", lateness)
            .groupBy(F.window("started_at", "1 day", startTime=zone_offset), "kind")
            .agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
            .select(F.col("window.start").alias("day_start"), "kind", "n", "failed"))


def daily_metrics_by_date(operations: DataFrame, zone: str) -> DataFrame:
    """Counts per local calendar date for update mode; late rows update their day."""
    return (operations.groupBy(S.local_date(F.col("started_at"), zone).alias("date"), "kind")
            .agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed")))


def upsert_days(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that replaces exactly the dates of the batch."""
    def write(batch: DataFrame, _: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))
    return write


def daily_cost_upsert(path: str, zone: str) -> Callable[[DataFrame, int], None]:
    """Recompute the days touched by new or newly settled calls from the call table.

    A late settlement belongs to the day its call was made, so the whole day is
    read again; the batch only names the days. The instants around them are
    literals of the scan, which skips the files and pages of all other days.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = batch.select(S.local_date(F.col("created_at"), zone).alias("date")).distinct()
        ends = days.agg(F.date_sub(F.min("date"), 1).cast("timestamp").alias("first"), F.date_add(F.max("date"), 2).cast("timestamp").alias("last")).first()
        if ends["first"] is None:
            return
        calls = (spark.read.parquet(f"{path}/calls").filter(F.col("created_at").between(F.lit(ends["first"]), F.lit(ends["last"])))
                 .withColumn("date", S.local_date(F.col("created_at"), zone)))
        fresh = (calls.join(days, "date", "left_semi").groupBy("date")
                 .agg(F.count("*").alias("api_calls"), F.sum("actual_usd").cast(USD).alias("actual_usd")))
        (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(f"{path}/days"))
    return write


class SourceStatus(StatefulProcessor):
    """Lifecycle states of the sources of one bucket; rejected transitions are emitted as such.

    A source's events of one batch are ordered together, however many Arrow
    chunks they come in: a source has a handful of transitions. The states of a
    bucket are one value, so that a batch reads and writes it once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("statuses", "held string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = self.state.get()
        current = dict(json.loads(kept[0])) if kept is not None else {}
        allowed = {"processing": ("pending", "failed"), "failed": ("processing",), "complete": ("processing", "complete"), "pending": ()}
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for source, seq, status in zip(events["source_id"].tolist(), events["seq"].tolist(), events["status"].tolist(), strict=True):
            before = current.get(source, "pending")
            valid = before in allowed[status]
            current[source] = now = status if valid else before
            if status != "pending":
                out.append((source, seq, status, now, valid))
        self.state.update((json.dumps(list(current.items())),))
        yield pd.DataFrame(out, columns=["source_id", "seq", "requested", "status", "valid"])

    def close(self) -> None:
        pass


def source_status(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``events(source_id, seq, status)`` to one row per requested transition."""
    return bucketed(events.select("source_id", "seq", "status"), "source_id", buckets).transformWithStateInPandas(
        SourceStatus(), "source_id string, seq long, requested string, status string, valid boolean",
        "Append", "None")


def last_recalled(events: DataFrame) -> DataFrame:
    """Latest recall per memory, for update mode."""
    return events.groupBy("memory_id").agg(F.max("recalled_at").alias("last_recalled_at"))


def budget_alert(path: str, budget: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of exposures and alerts per call.

    ``log(run_id, id, ordinal, at, step, amount)``: +reserved at step 1,
    actual-reserved at step 0. Exposure inside a batch is a split running sum,
    so one run may fill a batch; between batches only the exposure and the last
    instant of a run are kept. A call that is older than an earlier batch's last
    instant is judged after what has been counted already and marked ``late``:
    its exposure holds amounts that came after it in time. Outputs are stored per batch number, so a repeated batch replaces its
    own output and starts from the same state.
    """
    exposure_schema = f"run_id long, exposure {USD}, last timestamp"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        before = (spark.read.schema(exposure_schema).parquet(f"{path}/exposure/{number - 1}") if number
                  else spark.createDataFrame([], exposure_schema))
        running = prefix_sums(batch, ["run_id"], F.date_trunc("hour", "at"),
                              [F.col("at"), F.col("step"), F.col("ordinal")], F.col("amount"), "inside")
        start = F.coalesce("exposure", F.lit(0).cast(USD))
        calls = (running.filter("step = 1").join(before, "run_id", "left")
                 .withColumn("exposure_before", S.usd_add(start, F.col("inside")))
                 .withColumn("violates", S.usd_add(F.col("exposure_before"), F.col("amount")) > F.lit(budget).cast(USD))
                 .withColumn("late", F.coalesce(F.col("at") < F.col("last"), F.lit(False))))
        (calls.select("run_id", "id", "at", "exposure_before", "violates", "late")
         .write.mode("overwrite").parquet(f"{path}/alerts/{number}"))
        after = (batch.select("run_id", F.col("amount").alias("exposure"), F.col("at").alias("last")).unionByName(before)
                 .groupBy("run_id").agg(F.sum("exposure").cast(USD).alias("exposure"), F.max("last").alias("last")))
        after.write.mode("overwrite").parquet(f"{path}/exposure/{number}")
        batch.unpersist()
    return write


ALERT_SCHEMA = f"run_id long, id string, at timestamp, exposure_before {USD}, violates boolean, late boolean"


def weekly_changes(changes: DataFrame, anchor_offset: str, lateness: str = "1 day") -> DataFrame:
    """Changed memories per 7-day window that starts at the anchor: (week_start, memory_id, n).

    One row per memory instead of a set per week, so a week may hold any number.
    """
    return (changes.withWatermark("at", lateness)
            .groupBy(F.window("at", "7 days", startTime=anchor_offset), "memory_id").agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("week_start"), "memory_id", "n"))


def call_settlement(reservations: DataFrame, settlements: DataFrame, bound: str = "2 hours") -> DataFrame:
    """Reservations with their settlement; unmatched ones come out once the bound has passed.

    A settlement after the bound is in no row of this job: ``late_settlements``
    takes those up, whenever they come.
    """
    r = reservations.withWatermark("created_at", bound).alias("r")
    s = (settlements.select(F.col("id").alias("call_id"), "actual_usd", "completed_at")
         .withWatermark("completed_at", bound).alias("s"))
    on = (F.col("r.id") == F.col("s.call_id")) & (F.col("s.completed_at") >= F.col("r.created_at")) & (
        F.col("s.completed_at") <= F.col("r.created_at") + F.expr(f"interval {bound}"))
    return r.join(s, on, "left_outer").select("id", "run_id", "reserved_usd", "created_at", "actual_usd", "completed_at")


def late_settlements(calls_path: str, out: str, bound: str = "2 hours") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer over settlements(id, actual_usd, completed_at): rows of calls settled after the bound.

    The calls are a table of all reservations; only those that the batch names
    are read. Rows are stored per batch number, so a repeated batch replaces its
    own, and they replace the unsettled rows of ``call_settlement``.
    """
    def write(batch: DataFrame, number: int) -> None:
        calls = batch.sparkSession.read.parquet(calls_path).select("id", "run_id", "reserved_usd", "created_at")
        late = (calls.join(batch.select("id", "actual_usd", "completed_at"), "id")
                .filter(F.col("completed_at") > F.col("created_at") + F.expr(f"interval {bound}")))
        late.write.mode("overwrite").parquet(f"{out}/{number}")
    return write


class CallSettlement(StatefulProcessor):
    """The calls of one bucket, each from its reservation to its settlement, however late that is.

    Once its bound has passed a call is reported as open; a settlement after that
    is a correction of what was reported. ``keep_days`` of event time after the
    last event taken in, what is known of a call goes. Repeated events of a call
    change nothing until then. The calls of a bucket are one value and have one
    timer, at the first time that any of them waits for: a batch reads and writes
    the state once a bucket, not several times a call. Amounts and run numbers
    stay the texts that they came as.
    """

    def __init__(self, bound_seconds: int, keep_days: int) -> None:
        self.bound_us = bound_seconds * 1_000_000
        self.keep_us = max(keep_days * 86_400_000_000, self.bound_us + 1_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("calls", "timer_ms long, held string")

    def load(self) -> tuple[int | None, dict]:
        """The timer and what is held of each call: when it goes, and unless it is settled (run, reserved, created, opened, actual, completed)."""
        kept = self.state.get()
        return (None, {}) if kept is None else (kept[0], json.loads(kept[1]))

    def store(self, timer: int | None, held: dict) -> None:
        wake = min((self.due(x) if len(x) > 1 and x[3] is not None and not x[4] else x[0] for x in held.values()), default=None)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if held:
            self.state.update((wake, json.dumps(held)))
        else:
            self.state.clear()

    def due(self, call: list) -> int:
        return -(-(call[3] + self.bound_us) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timer, held = self.load()
        came: dict[str, list] = {}
        for part in rows:
            for name, *event in zip(*(part[x].tolist() for x in ("id", "run_id", "step", "at_us", "amount")), strict=True):
                came.setdefault(name, []).append(event)
        out = []
        for name, events in came.items():
            call = held.get(name) or [0, None, None, None, False, None, None]
            if len(call) == 1:
                continue
            ends, run, reserved, created, opened, actual, completed = call
            for run_id, step, at, amount in events:
                if step == 1 and created is None:
                    run, reserved, created = run_id, amount, at
                elif step == 0 and (completed is None or at < completed or at == completed and Decimal(amount) < Decimal(actual)):
                    actual, completed = amount, at
            ends = max(ends, -(-(max(x[2] for x in events) + self.keep_us) // 1000))
            if created is not None and completed is not None:
                held[name] = [ends]
                out.append((name, run, created, reserved, actual, completed, "late" if completed > created + self.bound_us else "settled", opened))
            else:
                held[name] = [ends, run, reserved, created, opened, actual, completed]
        self.store(timer, held)
        yield self.frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, held = self.load()
        out = []
        for name, call in list(held.items()):
            if len(call) > 1 and call[3] is not None and not call[4] and self.due(call) < now:
                call[4] = True
                out.append((name, call[1], call[3], call[2], None, None, "open", False))
            if call[0] < now:
                del held[name]
        # the timer that came is gone already
        self.store(None, held)
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "run_id", "created_us", "reserved_usd", "actual_usd", "completed_us", "state", "was_open"], dtype=object)
        return out.astype({"created_us": "int64", "completed_us": "Int64", "was_open": bool})

    def close(self) -> None:
        pass


def settlement_ledger(log: DataFrame, bound_seconds: int = 7200, lateness: str = "1 hour", keep_days: int = 90, buckets: int = BUCKETS) -> DataFrame:
    """``log(id, run_id, step, at, amount)`` to rows of calls that are settled, open or settled late.

    Step 1 is a reservation with its amount, step 0 a settlement with the real
    cost. A call gives ``settled``, or ``late``, or ``open`` and perhaps ``late``
    afterwards, which ``was_open`` then says. The calls are read once: a late
    settlement finds its call in the state. A batch takes its events in before its
    timers fire, so a call may come out late without having been open. Events
    without an id or time are left out.
    """
    events = log.filter("id is not null and at is not null").withWatermark("at", lateness).select(
        "id", F.col("run_id").cast("string").alias("run_id"), "step", "at", F.unix_micros("at").alias("at_us"), F.col("amount").cast(USD).cast("string").alias("amount"))
    out = bucketed(events, "id", buckets).transformWithStateInPandas(
        CallSettlement(bound_seconds, keep_days),
        "id string, run_id string, created_us long, reserved_usd string, actual_usd string, completed_us long, state string, was_open boolean",
        "Append", "EventTime")
    return out.select("id", F.col("run_id").cast("long").alias("run_id"), F.timestamp_micros("created_us").alias("created_at"),
                      F.col("reserved_usd").cast(USD).alias("reserved_usd"), F.col("actual_usd").cast(USD).alias("actual_usd"),
                      F.timestamp_micros("completed_us").alias("completed_at"), "state", "was_open")


DAY_SCHEMA = f"date date, settled long, late long, open long, actual_usd {USD}"


def corrected_days(path: str, zone: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of cost days over ``settlement_ledger``, corrected by late settlements.

    Each batch adds what it learned to the days before it, which are few; the
    days stand under the batch's number, so a repeated batch starts from the
    same days and replaces its own.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = (spark.read.schema(DAY_SCHEMA).parquet(f"{path}/{number - 1}") if number
                  else spark.createDataFrame([], DAY_SCHEMA))
        is_state = lambda name: (F.col("state") == name).cast("long")
        learned = batch.select(
            S.local_date(F.col("created_at"), zone).alias("date"), is_state("settled").alias("settled"), is_state("late").alias("late"),
            (is_state("open") - F.col("was_open").cast("long")).alias("open"), F.col("actual_usd"))
        (learned.unionByName(before).groupBy("date")
         .agg(*[F.sum(n).alias(n) for n in ("settled", "late", "open")], F.sum("actual_usd").cast(USD).alias("actual_usd"))
         .write.mode("overwrite").parquet(f"{path}/{number}"))
    return write


def first_outcome(results: DataFrame, lateness: str = "1 day") -> DataFrame:
    return results.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["run_id", "work_key", "proposal_index"])
