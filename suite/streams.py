"""Streaming jobs over stored tables, compared with their batch meaning.

A table arrives in parts, in the order of its time. Each part is run to its end
and the query stopped; the next run starts from the checkpoint. So state,
watermarks and sinks of every registered stream cross batches and restarts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memstrata.functions import scalars as S
from memstrata.streaming import jobs

from .planning import LIFECYCLE, status_events
from .registry import query, usd


PARTS = 4


class Feed:
    """A stored table that arrives part by part in a folder that a stream reads."""

    def __init__(self, c, table: str, frame: DataFrame, time: str, folder: str | None = None) -> None:
        def build() -> DataFrame:
            at = F.col(time).cast("double")
            cuts = frame.agg(F.percentile_approx(at, [i / PARTS for i in range(1, PARTS)], 1000).alias("q")).first().q or []
            # rows of one instant are never parted; rows without one come first
            part = sum((F.coalesce(at > F.lit(x), F.lit(False)).cast("int") for x in cuts), F.lit(0))
            return frame.withColumn("part", part)
        self.stored = c.space.table(f"stream_{table}", build, partition_by=["part"])
        self.folder = folder or f"{c.space.root}/stream_in/{table}_{uuid.uuid4().hex[:8]}"
        # an empty first file makes the folder
        self.stored.drop("part").limit(0).write.parquet(self.folder)
        self.frame = (c.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1000)
                      .option("recursiveFileLookup", "true").parquet(self.folder))

    def land(self, part: int) -> None:
        self.stored.filter(F.col("part") == part).drop("part").write.mode("append").parquet(self.folder)


def drain(c, frame: DataFrame, feeds: list[Feed], mode: str = "append", write=None) -> DataFrame | None:
    """Run the stream over each part in turn; the sink is a table in the shared folder."""
    jobs.use_rocksdb(c.spark)
    run = uuid.uuid4().hex[:8]
    out = f"{c.space.root}/stream_out/{run}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    for part in range(PARTS):
        for feed in feeds:
            feed.land(part)
        writer = frame.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{c.space.root}/stream_cp/{run}")
        if write is not None:
            writer = writer.foreachBatch(write)
        elif mode == "append":
            writer = writer.format("parquet").option("path", out)
        else:
            writer = writer.foreachBatch(put)
        writer.start().awaitTermination()
    if write is not None:
        return None
    fields = list(frame.schema.fields) + ([] if mode == "append" else [T.StructField("batch", T.IntegerType())])
    return c.spark.read.schema(T.StructType(fields)).parquet(out)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state per key of an update-mode output."""
    rest = [x for x in updates.columns if x not in keys and x != "batch"]
    return (updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*"))


@query("stream_source_dedup", "select id, content_hash from c_reg")
def _(c):
    calls = Feed(c, "calls", c.calls, "at")
    return drain(c, jobs.source_dedup(calls.frame), [calls]).select("id", "content_hash")


@query("stream_daily_metrics", """
select cast(date as varchar) date, kind, count(*) n, count(*) filter (status = 'failed') failed from c_opsd group by 1, 2""")
def _(c):
    ops = Feed(c, "operations", c.operations.select("id", "kind", "status", "started_at"), "started_at")
    return latest(drain(c, jobs.daily_metrics_by_date(ops.frame, "Asia/Seoul"), [ops], "update"), ["date", "kind"])


@query("stream_daily_windows", """
select d day_start, kind, count(*) n, count(*) filter (status = 'failed') failed from (
    select *, timezone('UTC', timezone('Asia/Seoul', date_trunc('day', timezone('Asia/Seoul', timezone('UTC', started_at))))) d from c_ops)
where d + to_days(1) <= (select max(started_at) from c_ops) - to_days(1) group by 1, 2""")
def _(c):
    ops = Feed(c, "operations", c.operations.select("id", "kind", "status", "started_at"), "started_at")
    return drain(c, jobs.daily_metrics(ops.frame, "15 hours"), [ops])


@query("stream_daily_costs", f"""
select cast(date as varchar) date, count(*) api_calls, {usd('sum(actual_usd)')} actual_usd from c_attr group by 1""")
def _(c):
    path = f"{c.space.root}/cost_days_{uuid.uuid4().hex[:8]}"
    calls = Feed(c, "cost_calls", c.api_calls.select("id", "created_at", "actual_usd"), "created_at", f"{path}/calls")
    drain(c, calls.frame, [calls], write=jobs.daily_cost_upsert(path, "Asia/Seoul"))
    return c.spark.read.schema("date date, api_calls long, actual_usd decimal(38,12)").parquet(f"{path}/days")


@query("stream_source_status", LIFECYCLE + " where first_call_id % 6 <> 5")
def _(c):
    events = Feed(c, "status", status_events(c).withColumn("seq", F.col("seq").cast("long")), "seq")
    steps = drain(c, jobs.source_status(events.frame), [events])
    return steps.filter("valid").groupBy("source_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("n_valid"))


@query("stream_last_recalled", "select memory_id, max(recalled_at) last_recalled_at from c_recalls group by 1")
def _(c):
    recalls = Feed(c, "recalls", c.recall_events, "recalled_at")
    updates = drain(c, jobs.last_recalled(recalls.frame), [recalls], "update")
    return latest(updates, ["memory_id"])


@query("stream_budget_alert", f"""
with log as (select run_id, id, ordinal, created_at t, 1 step, reserved_usd amount from c_api where run_id is not null
    union all select run_id, id, ordinal, completed_at, 0, actual_usd - reserved_usd from c_api where run_id is not null and completed_at is not null),
x as (select *, coalesce(sum(amount) over (partition by run_id order by t, step, ordinal rows between unbounded preceding and 1 preceding), 0) exposure from log)
select run_id, id, {usd('exposure')} exposure_before, exposure + amount > 0.25 violates from x where step = 1""")
def _(c):
    reserve = c.api_calls.select("run_id", "id", "ordinal", F.col("created_at").alias("at"), F.lit(1).alias("step"), F.col("reserved_usd").alias("amount"))
    settle = c.api_calls.filter("completed_at is not null").select(
        "run_id", "id", "ordinal", F.col("completed_at").alias("at"), F.lit(0).alias("step"), S.usd_sub(F.col("actual_usd"), F.col("reserved_usd")).alias("amount"))
    log = reserve.unionByName(settle).filter("run_id is not null")
    path = f"{c.space.root}/budget_{uuid.uuid4().hex[:8]}"
    events = Feed(c, "budget_log", log, "at")
    drain(c, events.frame, [events], write=jobs.budget_alert(path, "0.25"))
    alerts = c.spark.read.schema(jobs.ALERT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/alerts")
    return alerts.select("run_id", "id", "exposure_before", "violates")


@query("stream_weekly_changes", """
with ch as (select memory_id, related_at "at" from c_rel union all select id, created_at from c_mem where depth >= 1)
select w week_start, memory_id, count(*) n from (select memory_id, TIMESTAMP '2024-01-01' + to_days(cast(7 * (date_diff('day', TIMESTAMP '2024-01-01', "at") // 7) as integer)) w, "at" from ch)
where w + to_days(7) <= (select max("at") from ch) - to_days(1) group by 1, 2""")
def _(c):
    changes = (c.relations.select("memory_id", F.col("related_at").alias("at"))
               .unionByName(c.memories.filter("depth >= 1").select(F.col("id").alias("memory_id"), F.col("created_at").alias("at"))))
    # windows count from the epoch, a Thursday; the anchor is a Monday
    feed = Feed(c, "changes", changes, "at")
    return drain(c, jobs.weekly_changes(feed.frame, "4 days"), [feed])


@query("stream_call_settlement_join", f"""
select id, run_id, {usd('reserved_usd')} reserved_usd, {usd('actual_usd')} actual_usd, completed_at from c_api where actual_usd is not null
    or created_at + to_hours(2) < (select least(max(created_at), max(completed_at)) from c_api) - to_hours(3)""")
def _(c):
    calls = Feed(c, "reservations", c.api_calls.select("id", "run_id", "reserved_usd", "created_at"), "created_at")
    settled = Feed(c, "settlements", c.api_calls.filter("actual_usd is not null").select("id", "actual_usd", "completed_at"), "completed_at")
    out = drain(c, jobs.call_settlement(calls.frame, settled.frame), [calls, settled])
    # unmatched calls near the end of the data wait for the watermark
    edge = c.api_calls.agg(F.least(F.max("created_at"), F.max("completed_at")).alias("m")).first().m
    final = F.col("created_at") + F.expr("interval 2 hours") < F.lit(edge) - F.expr("interval 3 hours")
    return out.filter(F.col("actual_usd").isNotNull() | final).select("id", "run_id", "reserved_usd", "actual_usd", "completed_at")


def settlement_events(c) -> Feed:
    reserve = c.api_calls.select("id", "run_id", F.lit(1).alias("step"), F.col("created_at").alias("at"), F.col("reserved_usd").alias("amount"))
    settle = c.api_calls.filter("actual_usd is not null").select(
        "id", "run_id", F.lit(0).alias("step"), F.col("completed_at").alias("at"), F.col("actual_usd").alias("amount"))
    return Feed(c, "settlement_log", reserve.unionByName(settle), "at")


@query("stream_settlement_ledger", f"""
select id, run_id, case when actual_usd is null then 'open' when completed_at > created_at + to_minutes(30) then 'late' else 'settled' end state, {usd('actual_usd')} actual_usd
from c_api where actual_usd is not null or created_at + to_minutes(30) < (select greatest(max(created_at), max(completed_at)) from c_api) - to_hours(2)""")
def _(c):
    log = settlement_events(c)
    rows = drain(c, jobs.settlement_ledger(log.frame, 1800), [log])
    # a correction stands for the open row before it; calls near the end of the data wait for the watermark
    edge = c.api_calls.agg(F.greatest(F.max("created_at"), F.max("completed_at")).alias("m")).first().m
    final = F.col("created_at") + F.expr("interval 30 minutes") < F.lit(edge) - F.expr("interval 2 hours")
    last = rows.groupBy("id").agg(F.max_by(F.struct("run_id", "created_at", "state", "actual_usd"), F.col("state") != "open").alias("r"))
    return last.select("id", "r.*").filter((F.col("state") != "open") | final).select("id", "run_id", "state", "actual_usd")


@query("stream_corrected_days", f"""
select cast(cast(timezone('Asia/Seoul', timezone('UTC', created_at)) as date) as varchar) date, count(*) filter (completed_at <= created_at + to_minutes(30)) settled,
    count(*) filter (completed_at > created_at + to_minutes(30)) late, {usd('sum(actual_usd)')} actual_usd from c_api group by 1 having count(actual_usd) > 0""")
def _(c):
    log = settlement_events(c)
    path = f"{c.space.root}/corrected_{uuid.uuid4().hex[:8]}"
    batches = []
    days = jobs.corrected_days(path, "Asia/Seoul")

    def write(batch: DataFrame, number: int) -> None:
        days(batch, number)
        batches.append(number)
    drain(c, jobs.settlement_ledger(log.frame, 1800), [log], write=write)
    return (c.spark.read.schema(jobs.DAY_SCHEMA).parquet(f"{path}/{max(batches)}")
            .filter("settled + late > 0").select("date", "settled", "late", "actual_usd"))


@query("stream_first_outcome", "select distinct run_id, work_key, proposal_index from c_results")
def _(c):
    twice = c.relation_results.unionByName(c.relation_results)
    outcomes = Feed(c, "outcomes", twice, "at")
    out = drain(c, jobs.first_outcome(outcomes.frame, "60 days"), [outcomes])
    return out.select("run_id", "work_key", "proposal_index")
