"""Scans, sources and sinks. Files are written into the shared folder and read back."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from memstrata.operators import graph
from memstrata.plans import daily_report as report, report_refresh as refreshing
from memstrata.session import durable
from memstrata.sources import archive, dataset as stored, ledger, vectors, versions
from memstrata.sources.corpus import SPACE

from .aggregates import REPORT, ZONE, dataset, source_details, stored_report, whole_report
from .registry import query, usd
from .retrieval import gold_sessions, metrics


def archive_folder(c) -> str:
    """The written archive: some bodies are changed, some headers broken, some files missing."""
    def build():
        kind = F.col("first_call_id") % 40
        texts = c.source_texts.withColumn("raw", F.when(kind == 0, F.concat("raw", F.lit("x"))).otherwise(F.col("raw")))
        files = (archive.archive_text(texts).join(c.registered.select("id", "relative_path", "first_call_id"), "id")
                 .filter(kind != 2)
                 .withColumn("text", F.when(kind == 1, F.expr("substring(text, 2)")).otherwise(F.col("text"))))
        archive.write_archive(files, f"{c.space.root}/archive")
        return files.select("id")
    c.space.table("archived_ids", build)
    return f"{c.space.root}/archive"


def scanned(c):
    return c.space.table("scanned", lambda: archive.scan_archive(c.spark, archive_folder(c)))


@query("source_archive_scan", """
select 'sources/' || strftime(created_at, '%Y/%m/%d') || '/src_' || content_hash || '.md' relative_path,
    case when first_call_id % 40 <> 1 then id end id, case when first_call_id % 40 <> 1 then created_at end created_at,
    case when first_call_id % 40 <> 1 then strlen(raw) + (first_call_id % 40 = 0)::int end n_bytes, first_call_id % 40 > 1 valid from c_reg where first_call_id % 40 <> 2""")
def _(c):
    return scanned(c).select("relative_path", "id", "created_at", F.octet_length("raw").alias("n_bytes"), "valid")


@query("source_artifact_status", r"""
select id, case when first_call_id % 40 = 3 then 'outside_corpus' when first_call_id % 40 = 2 then 'missing' when first_call_id % 40 = 1 then 'invalid_header' when first_call_id % 40 = 0 then 'hash_mismatch' else 'available' end artifact_status,
    case when first_call_id % 40 > 3 then length(raw) + len(regexp_extract_all(raw, '[\x{10000}-\x{10FFFF}]')) end raw_characters, case when first_call_id % 40 > 3 then strlen(raw) end raw_bytes from c_reg""")
def _(c):
    moved = F.when(F.col("first_call_id") % 40 == 3, F.concat(F.lit("elsewhere/"), "id")).otherwise(F.col("relative_path"))
    return archive.artifact_status(c.registered.withColumn("relative_path", moved).drop("first_call_id"), scanned(c)).select(
        "id", "artifact_status", "raw_characters", "raw_bytes")


@query("source_register", """
select c.call_id, 'src_' || c.h source_id, c.call_id = r.first_call_id and r.first_call_id % 2 = 1 new_source from c_calls c join c_reg r on r.content_hash = c.h""")
def _(c):
    known = c.registered.filter("first_call_id % 2 = 0")
    _rows, results = archive.register_sources(c.calls, known)
    return results


@query("orphan_source_recovery", """
select id, case when first_call_id % 3 = 0 then 'pending' when first_call_id % 3 = 1 then 'pending' else status end status from c_reg
where first_call_id % 3 <> 0 or first_call_id % 40 > 2""")
def _(c):
    known = c.registered.filter("first_call_id % 3 <> 0").withColumn(
        "status", F.when(F.col("first_call_id") % 3 == 1, "processing").otherwise(F.col("status")))
    return archive.recover_sources(scanned(c), known).select("id", "status")


LOADED = """
with n as (select conv_id, count(*) turns from conversations group by 1)
select q.query_id question_id, v.ordinal, v.session_id, v.ts, n.turns from c_conv v join c_q q on q.item_id = v.item_id join n on n.conv_id = v.conv_id"""


def dataset_file(c):
    """The session dataset in its stored form, one row a question."""
    def build():
        q, s = dataset(c)
        day = lambda x: F.date_format(x, "yyyy/MM/dd (E) HH:mm")
        hay = (s.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "session_id", "ts", "turns"))).alias("h")))
        pick = lambda f: F.transform("h", lambda x: f(x))
        return q.join(hay, "question_id").select(
            "question_id", "question_type", F.lit("?").alias("question"), F.lit("!").alias("answer"), day("question_ts").alias("question_date"),
            F.array().cast("array<string>").alias("answer_session_ids"), pick(lambda x: day(x["ts"])).alias("haystack_dates"),
            pick(lambda x: x["session_id"]).alias("haystack_session_ids"), pick(lambda x: x["turns"]).alias("haystack_sessions"))
    return c.space.table("dataset_file", build)


@query("session_dataset_load", LOADED)
def _(c):
    path = f"{c.space.root}/dataset_json"
    dataset_file(c).write.mode("overwrite").json(path)
    _q, sessions = stored.load_dataset(c.spark, path, array=False)
    # stored order is the ordinal inside the question's list
    return sessions.select("question_id", "ordinal", "session_id", "ts", F.size("turns").alias("turns"))


@query("session_dataset_array", LOADED)
def _(c):
    # one array a file, a thousand questions in each
    path = f"{c.space.root}/dataset_arrays"
    rows = dataset_file(c)
    files = rows.count() // 1000 + 1
    place = Window.partitionBy("part").orderBy("question_id")
    last = Window.partitionBy("part").orderBy(F.desc("question_id"))
    lines = (rows.select("question_id", F.to_json(F.struct(*rows.columns)).alias("item"),
                         F.pmod(F.xxhash64("question_id"), F.lit(files)).alias("part"))
             .withColumn("open", F.when(F.row_number().over(place) == 1, "[").otherwise(","))
             .withColumn("close", F.when(F.row_number().over(last) == 1, "]").otherwise("")))
    (lines.repartition("part").sortWithinPartitions("part", "question_id")
     .select("part", F.concat("open", "item", "close").alias("value"))
     .write.mode("overwrite").partitionBy("part").text(path))
    _q, sessions = stored.load_dataset(c.spark, path)
    return sessions.select("question_id", "ordinal", "session_id", "ts", F.size("turns").alias("turns"))


@query("ledger_snapshot_scan", """
select 'activity_operations' as name, count(*) n from c_ops union all select 'api_calls', count(*) from c_api union all select 'memories', count(*) from c_mem
union all select 'derived_from', count(*) from c_df union all select 'runs', count(*) from c_runs union all select 'run_work', count(*) from c_work
union all select 'activity_relation_results', count(*) from c_results union all select 'state', 0 union all select 'sources', 0 union all select 'activity_api_calls', 0
union all select 'usage', count(*) from c_api where input_tokens is not null union all select 'raw_bytes', count(raw_bytes) from c_ops""")
def _(c):
    for table in (c.operations, c.api_calls, c.memories, c.derived_from, c.runs, c.run_work, c.relation_results):
        table.schema  # noqa: B018  the stored tables exist from here on
    tables = ledger.scan_ledger(c.spark, c.space.root)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [one(name, df) for name, df in tables.items()]
    parts.append(one("usage", tables["api_calls"].filter("usage.input_tokens is not null")))
    parts.append(one("raw_bytes", tables["activity_operations"].filter("details.raw_bytes is not null")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


CUT = "2024-01-15"


@query("ledger_versions", f"""
with api as (select count(*) n, count(*) filter (created_at < TIMESTAMP '{CUT}') early, count(actual_usd) settled,
        count(actual_usd) filter (completed_at < TIMESTAMP '{CUT}' and created_at < TIMESTAMP '{CUT}') early_settled from c_api),
    ops as (select count(*) n, count(*) filter (started_at < TIMESTAMP '{CUT}') early from c_ops), mem as (select count(*) n from c_mem)
select 1 as version, 'api_calls' as name, early n, early_settled settled from api union all select 2, 'api_calls', n, settled from api
union all select 3, 'api_calls', n, settled from api
union all select 1, 'activity_operations', early, null from ops union all select 2, 'activity_operations', n, null from ops
union all select 3, 'activity_operations', n, null from ops
union all select 1, 'memories', 0, null union all select 2, 'memories', 0, null union all select 3, 'memories', n, null from mem""")
def _(c):
    # a folder of its own for each call, as versions can only grow
    folder = f"{c.space.root}/ledger_{uuid.uuid4().hex[:8]}"
    cut = F.lit(CUT).cast("timestamp")
    known = F.coalesce(F.col("completed_at") < cut, F.lit(False))
    early_calls = c.api_calls.filter(F.col("created_at") < cut).withColumns(
        {x: F.when(known, F.col(x)) for x in ("actual_usd", "usage_json", "completed_at")})
    early = F.col("started_at") < cut
    first = versions.commit(c.spark, folder, 0, replace={"api_calls": early_calls, "activity_operations": c.operations.filter(early)})
    # the readers of the first version are made before the next ones and read after them
    views = {first: versions.read_version(c.spark, folder)}
    second = versions.commit(c.spark, folder, first, replace={"api_calls": c.api_calls},
                             append={"activity_operations": c.operations.filter(~early)})
    views[second] = versions.read_version(c.spark, folder)
    # a writer that still stands on the first version goes on top of the second
    third = versions.commit(c.spark, folder, first, append={"memories": c.memories})
    views[third] = versions.read_version(c.spark, folder)
    out = None
    for version, tables in views.items():
        for name in ("api_calls", "activity_operations", "memories"):
            settled = F.count("actual_usd") if name == "api_calls" else F.lit(None).cast("long")
            row = tables[name].agg(F.count("*").alias("n"), settled.alias("settled")).select(
                F.lit(version).alias("version"), F.lit(name).alias("name"), "n", "settled")
            out = row if out is None else out.unionByName(row)
    return out


@query("embedding_scan", "select memory_id, len(vector) dims, round(vector[1]::double, 6) first_value, round(list_sum(vector::double[]), 6) total from c_emb")
def _(c):
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    text = c.embeddings.withColumn("vector", F.to_json("vector"))
    return vectors.scan_space(text, SPACE).select(
        "memory_id", F.size("vector").alias("dims"), F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"), F.round(total, 6).alias("total"))


@query("embedding_upsert", """
select memory_id, round(vector[1]::double * case when vec_id % 3 = 0 then 2 else 1 end, 6) first_value, vec_id % 3 = 1 rejected from c_emb""")
def _(c):
    kind = F.col("vec_id") % 3
    base = c.embeddings.select("memory_id", "space", "dimensions", "vector")
    incoming = c.embeddings.filter(kind < 2).select(
        "memory_id", "space", F.when(kind == 1, 63).otherwise(64).alias("dimensions"),
        F.when(kind == 1, F.slice("vector", 1, 63)).otherwise(F.transform("vector", lambda x: (x * 2).cast("float"))).alias("vector"), F.lit(1).alias("ordinal"))
    merged, rejected = vectors.upsert(base, incoming)
    flagged = rejected.select("memory_id", F.lit(True).alias("r"))
    return merged.join(flagged, "memory_id", "left").select(
        "memory_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"), F.col("r").isNotNull().alias("rejected"))


def length_vectors(texts):
    """A deterministic stand-in for an embedding model."""
    import numpy as np
    n = texts.str.len().to_numpy()
    return [((k % np.arange(2, 66)) + 1).astype("float32") for k in n]


def embed(texts):
    import pandas as pd
    return pd.Series(length_vectors(texts))


@query("embedding_backfill", """
select id memory_id, 64 dimensions, (length(content) % 2 + 1)::double first_value, (length(content) % 65 + 1)::double last_value from c_mem where seq % 7 = 0""")
def _(c):
    fresh = vectors.backfill(c.memories, c.embeddings.filter("seq % 7 <> 0"), SPACE, embed)
    return fresh.select("memory_id", "dimensions", F.col("vector")[0].cast("double").alias("first_value"), F.col("vector")[63].cast("double").alias("last_value"))


@query("enrichment_cache", "select doc_id call_id, length(text) result from documents")
def _(c):
    keyed = c.calls.select("call_id", "raw", F.sha2("raw", 256).alias("key"))
    cache = c.source_texts.filter("first_call_id % 2 = 0").select(F.col("content_hash").alias("cache_key"), F.length("raw").alias("result"))
    out, _grown = vectors.enrich_through_cache(
        keyed, "key", cache, lambda missing: missing.select("cache_key", F.length("raw").alias("result")))
    return out.select("call_id", "result")


@query("ledger_export", f"select id, run_id, operation, {usd('reserved_usd')} reserved_usd, {usd('actual_usd')} actual_usd, input_tokens from c_api")
def _(c):
    path = f"{c.space.root}/ledger_jsonl"
    ledger.export_calls(c.api_calls, path)
    from memstrata.schemas import schema
    back = ledger.parse_json_columns(c.spark.read.schema(schema("api_calls")).json(path))
    return back.select("id", "run_id", "operation", "reserved_usd", "actual_usd", F.col("usage.input_tokens").alias("input_tokens"))


@query("report_export", f"with {REPORT} select * from rep where date between '2024-01-05' and '2024-01-20'")
def _(c):
    path = f"{c.space.root}/reports"
    whole = stored_report(c)
    days = lambda a, b: whole.join(report.date_range(c.spark, a, b), "date", "left_semi")
    ledger.replace_dates(days("2024-01-05", "2024-01-15").withColumn("costs_api_calls", F.lit(0).cast("long")), path)
    ledger.replace_dates(days("2024-01-05", "2024-01-20"), path)
    return c.spark.read.schema(whole.schema).parquet(path)


@query("report_refresh_diff", """
select distinct cast(date as varchar) date from c_attr where completed_at >= TIMESTAMP '2024-01-20' and date >= DATE '2024-01-03' and date < DATE '2024-01-28'""")
def _(c):
    # the earlier report did not know the settlements after the cut
    late = F.col("completed_at") >= F.lit("2024-01-20").cast("timestamp")
    before = c.api_calls.withColumns({"actual_usd": F.when(~F.coalesce(late, F.lit(False)), F.col("actual_usd"))})
    prior = report.fingerprints(whole_report(c, before))
    day = lambda t: F.lit(t).cast("date")
    return report.changed_days(stored_report(c), prior, day("2024-01-03"), day("2024-01-28")).select("date")


def ledger_now(c):
    return refreshing.Ledger(c.activity, source_details(c), c.memory_rows, c.api_calls, c.api_links, c.runs, c.run_work, c.relation_results)


def unsettled(calls):
    """The calls before the settlements after the cut."""
    late = F.coalesce(F.col("completed_at") >= F.lit("2024-01-20").cast("timestamp"), F.lit(False))
    return calls.withColumn("actual_usd", F.when(~late, F.col("actual_usd")))


def refreshed_from(c, before):
    """The report of an earlier ledger brought up to the present one by the rows that differ."""
    now = ledger_now(c)
    day = lambda t: F.lit(t).cast("date")
    roots = durable(graph.component_roots(before.operations))
    # the earlier report was made two days before
    prior = durable(refreshing.build_report(before, roots, ZONE, day("2024-01-10"), day("2024-01-26")))
    changes = {name: refreshing.changed_rows(getattr(before, name), getattr(now, name))
               for name in ("operations", "memories", "calls", "run_work", "results")
               if getattr(before, name) is not getattr(now, name)}
    return refreshing.refresh(prior, roots, now, changes, ZONE, day("2024-01-10"), day("2024-01-26"), day("2024-01-28"))


@query("report_refresh_incremental", f"with {REPORT} select * from rep")
def _(c):
    now = ledger_now(c)
    # operations, memories and results that came late, work that was still open, calls not yet settled
    before = now.with_tables(
        operations=now.operations.filter(~((F.col("started_at") >= "2024-01-24") & (F.crc32("id") % 3 == 0))),
        memories=now.memories.filter(F.crc32("id") % 400 != 0),
        calls=unsettled(now.calls),
        run_work=now.run_work.withColumn("status", F.when(F.crc32("work_key") % 500 == 0, "pending").otherwise(F.col("status"))),
        results=now.results.filter(F.col("at") < "2024-01-27"))
    report_now, _, _ = refreshed_from(c, before)
    return report_now


@query("report_refresh_days", """
select cast(date as varchar) date, true changed from c_attr where completed_at >= TIMESTAMP '2024-01-20' group by 1
union select unnest(['2024-01-26', '2024-01-27']), true""")
def _(c):
    now = ledger_now(c)
    _, _, days = refreshed_from(c, now.with_tables(calls=unsettled(now.calls)))
    return days


@query("result_artifact_load", f"""
with g as (select query_id, list_sort(list(distinct 'sess_' || s.first_call_id)) g from c_gold join c_reg s on s.id = source_id group by 1)
select f.query_id question_id, f.condition, coalesce(array_to_string(g.g, ','), '') gold_sessions, f.correct,
    (select string_agg(memory_id, ',' order by rank) from c_cand c where c.condition = f.condition and c.query_id = f.query_id and rank <= 5) selected,
    {usd('(f.item_id % 7 + 1) * 0.001')} shared_usd from c_flags f left join g on g.query_id = f.query_id""")
def _(c):
    lists = c.candidates.groupBy("condition", "query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("candidates"))
    gold = gold_sessions(c).groupBy("query_id").agg(F.array_sort(F.collect_set("session_id")).alias("gold_sessions"))
    usage = lambda a, b: F.struct(F.lit(1).alias("calls"), F.col(a).alias("settled_usd"), F.col(b).alias("reserved_usd"))
    rows = metrics(c).join(lists, ["condition", "query_id"], "left")
    nested = rows.groupBy("query_id").agg(
        F.first("question_type").alias("question_type"), F.first(usage("shared_usd", "shared_reserved")).alias("shared_ingestion_usage"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", F.struct(
            "candidates", F.slice("candidates", 1, 5).alias("selected"), F.col("recall_tokens").alias("recall_input_tokens"), "correct",
            usage("condition_usd", "condition_reserved").alias("usage")))))).alias("conditions"))
    path = f"{c.space.root}/results"
    nested.join(gold, "query_id", "left").withColumnRenamed("query_id", "question_id").write.mode("overwrite").json(path)
    out = stored.result_rows(stored.load_results(c.spark, path))
    return out.select("question_id", "condition", F.coalesce("gold_sessions", F.array().cast("array<string>")).alias("gold_sessions"),
                      "correct", "selected", "shared_usd")


@query("metrics_sink", "select query_id, condition, hit from c_flags")
def _(c):
    path = f"{c.space.root}/metrics_json"
    ledger.write_metrics(metrics(c).select("query_id", "condition", "hit"), "query_id", path)
    return c.spark.read.schema("query_id string, condition string, hit boolean").json(path)


@query("late_content_fetch", "select m.id, m.content from c_mem m where m.id in (select memory_id from c_results union select related_memory_id from c_results)")
def _(c):
    ids = c.relation_results.select("memory_id").unionByName(c.relation_results.select(F.col("related_memory_id").alias("memory_id")))
    return ledger.late_content(ids, c.contents_of)


