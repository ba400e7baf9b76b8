"""Scalar helpers, each applied to a bound table."""

from decimal import Decimal

from pyspark.sql import functions as F

from memstrata.config import ModelPrice, price_table
from memstrata.functions import scalars as S

from .registry import query, usd

ZONE = "Asia/Seoul"


@query("query_terms", r"""
select query_id, array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(ts), lambda x: {'p': list_position(ts, x), 't': x})), lambda s: s.t), 1, 64), ',') terms
from (select query_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') ts from c_q)""")
def _(c):
    return c.questions.select("query_id", S.query_terms(F.col("text")).alias("terms"))


@query("content_id", "select doc_id, 'src_' || sha256(text) id from documents")
def _(c):
    return c.raw("documents").select("doc_id", S.content_id(F.col("text")).alias("id"))


@query("cosine", """
select memory_id, round(list_dot_product(vector::double[], list_reverse(vector)::double[]) / list_dot_product(vector::double[], vector::double[]), 6) score from c_emb""")
def _(c):
    return c.embeddings.select("memory_id", F.round(S.cosine(F.col("vector"), F.reverse("vector")), 6).alias("score"))


@query("local_date", "select event_id, strftime(timezone('Asia/Seoul', timezone('UTC', ts)), '%Y-%m-%d') local_date from events")
def _(c):
    return c.raw("events").select("event_id", S.local_date(F.col("ts"), ZONE).alias("local_date"))


@query("local_day_start", """
select event_id, timezone('UTC', timezone('Asia/Seoul', date_trunc('day', timezone('Asia/Seoul', timezone('UTC', ts))))) day_start from events""")
def _(c):
    return c.raw("events").select("event_id", S.local_day_start(S.local_date(F.col("ts"), ZONE), ZONE).alias("day_start"))


def prices(c):
    # fixed values: a sample price list per million tokens
    return price_table(c.spark, [
        ModelPrice("model-a", Decimal("1.25"), Decimal("0.125"), Decimal("1.5"), Decimal("10"), 1400, Decimal("2"), Decimal("1.5")),
        ModelPrice("model-b", Decimal("0.25"), Decimal("0.025"), Decimal("0.3"), Decimal("2")),
    ])


@query("token_cost", """
with t as (select *, model = 'model-a' a, model = 'model-a' and input_tokens > 1400 long from c_api)
select id, case when input_tokens is not null then round(((input_tokens - cached_tokens - write_tokens) * case when a then 1.25 else 0.25 end + cached_tokens * case when a then 0.125 else 0.025 end
    + write_tokens * case when a then 1.5 else 0.3 end)::double * case when long then 2 else 1 end / 1000000
    + (output_tokens * case when a then 10 else 2 end)::double * case when long then 1.5 else 1 end / 1000000, 9) end cost from t""")
def _(c):
    usage = F.from_json("usage_json", "input_tokens long, cached_input_tokens long, output_tokens long, cache_write_tokens long")
    priced = c.api_calls.withColumn("u", usage).join(prices(c), "model")
    return priced.select("id", S.token_cost(F.col("u.input_tokens"), F.col("u.cached_input_tokens"),
                                            F.col("u.cache_write_tokens"), F.col("u.output_tokens"), F.col).alias("cost"))


@query("max_reservation", """
select d.doc_id, m.model, round(((strlen(text) + 8192)::double * case when m.model = 'model-a' then 1.5 * case when strlen(text) + 8192 > 1400 then 2 else 1 end else 0.3 end
    + 4096 * case when m.model = 'model-a' then 10 * case when strlen(text) + 8192 > 1400 then 1.5 else 1 end else 2 end) / 1000000, 9) reservation
from documents d, (select unnest(['model-a', 'model-b']) model) m""")
def _(c):
    both = c.raw("documents").select("doc_id", "text", F.explode(F.array(F.lit("model-a"), F.lit("model-b"))).alias("model"))
    return both.join(prices(c), "model").select(
        "doc_id", "model", S.max_reservation(S.utf8_length(F.col("text")), F.lit(4096), F.col).alias("reservation"))


@query("carry_key_parse", """
select run_id, work_key, 'carry:' || run_id || ':' || work_key carry_key, run_id carry_run, work_key original_key, false malformed from c_work""")
def _(c):
    k = c.run_work.select("run_id", "work_key", F.concat(F.lit("carry:"), "run_id", F.lit(":"), "work_key").alias("carry_key"))
    key = F.col("carry_key")
    return k.select("*", S.carry_run(key).alias("carry_run"), S.carry_original_key(key).alias("original_key"),
                    S.carry_malformed(key).alias("malformed"))


@query("canonical_id_set", """
select child_id, '["' || string_agg(parent_id, '","' order by parent_id) || '"]' id_set from c_df group by 1""")
def _(c):
    return c.derived_from.groupBy("child_id").agg(S.canonical_id_set(F.collect_list("parent_id")).alias("id_set"))


@query("json_shallow_merge", """
select event_id, string_agg(key || '=' || coalesce(value, 'null'), ',' order by key) merged from (
    select event_id, 'k' as key, cast(event_id % 7 as varchar) as value from events
    union all select event_id, 'u', cast(user_id as varchar) from events union all select event_id, 'old', '1' from events) group by 1""")
def _(c):
    old = F.concat(F.lit('{"old":1,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    new = F.concat(F.lit('{"k":'), F.col("event_id") % 7, F.lit(',"u":'), F.col("user_id"), F.lit("}"))
    merged = c.raw("events").select("event_id", S.json_shallow_merge(old, new).alias("m"))
    return merged.select("event_id", F.array_sort(F.transform(
        F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null"))))).alias("merged"))


@query("preview", "select id, substr(content, 1, 240) preview from c_mem")
def _(c):
    return c.memories.select("id", S.preview(F.col("content")).alias("preview"))


@query("origin_key", """
select id, case when depth = 0 then 'source:' || source_ref || ':' || regexp_extract(id, '_(\\d+)$', 1) else origin_key end origin_key from c_mem""")
def _(c):
    kept = F.regexp_extract("origin_key", r"^run:\d+:(.*):\d+$", 1)
    return c.memories.select("id", F.when(
        F.col("depth") == 0, S.source_origin_key(F.col("source_ref"), F.regexp_extract("id", r"_(\d+)$", 1))).otherwise(
        S.run_origin_key(F.col("dream_revision"), kept, F.lit(0))).alias("origin_key"))


@query("dataset_timestamp", "select event_id, date_trunc('minute', ts) parsed from events")
def _(c):
    text = F.concat(F.date_format("ts", "yyyy/MM/dd"), F.lit(" ("), F.date_format("ts", "E"), F.lit(") "), F.date_format("ts", "HH:mm"))
    return c.raw("events").select("event_id", S.dataset_timestamp(text).alias("parsed"))


@query("iso_utc", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') iso from events")
def _(c):
    return c.raw("events").select("event_id", S.iso_utc(F.col("ts")).alias("iso"))


@query("rate_pp", """
select user_id, round(100.0::double * count(*) filter (event_type = 'error') / nullif(count(*) filter (event_type = 'view'), 0), 9) pp from events group by 1""")
def _(c):
    n = lambda t: F.count_if(F.col("event_type") == t)
    return c.raw("events").groupBy("user_id").agg(S.percentage_points(S.rate(n("error"), n("view"))).alias("pp"))


@query("root_threshold", "select id, cast(pow(3, depth) as double) threshold from c_mem")
def _(c):
    return c.memories.select("id", S.root_threshold(3, F.col("depth")).alias("threshold"))


@query("utf16_length", r"""
select doc_id, length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) n16, strlen(text) n8 from documents""")
def _(c):
    return c.raw("documents").select("doc_id", S.utf16_length(F.col("text")).alias("n16"), S.utf8_length(F.col("text")).alias("n8"))


@query("lenient_json_access", """
select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then null else cast(json_extract(props, '$.k') as bigint) end number from events""")
def _(c):
    k = F.get_json_object("props", "$.k")
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":"x'), k, F.lit('"}')))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"other":'), k, F.lit("}"))).otherwise(F.col("props")))
    return c.raw("events").select("event_id", S.json_number(text, "$.k").alias("number"))


@query("abstention_flag", "select query_id, contains(query_id, '_abs') abstention from c_q")
def _(c):
    return c.questions.select("query_id", S.abstention_flag(F.col("query_id")).alias("abstention"))


@query("judge_score", "select doc_id, contains(lower(text), 'yes') correct from documents")
def _(c):
    return c.raw("documents").select("doc_id", S.judge_score(F.col("text")).alias("correct"))


@query("judge_prompt_route", "select query_id, case when item_id % 13 = 0 then 'abstention' else question_type end template from c_q")
def _(c):
    from memstrata.sources.corpus import QUESTION_TYPES
    return c.questions.select("query_id", S.judge_prompt_route(F.col("question_type"), F.col("query_id"), list(QUESTION_TYPES)).alias("template"))


@query("work_identity", "select run_id, work_key, run_id || '/' || work_key identity from c_work")
def _(c):
    return c.run_work.select("run_id", "work_key", S.work_identity(F.col("run_id"), F.col("work_key")).alias("identity"))


@query("large_ledger_run_cost", f"""
select l_suppkey run_id, count(*) calls, {usd('sum(cast(round(l_extendedprice * 100) as decimal(20,0)) * 0.0000001)')} reserved_usd from lineitem group by 1""")
def _(c):
    from memstrata.operators import accounting
    calls = c.raw("lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.lit(None).cast("decimal(38,12)").alias("actual_usd"),
        (F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)") * F.lit("0.0000001").cast("decimal(8,7)")).cast("decimal(38,12)").alias("reserved_usd"))
    return accounting.run_cost_split(calls).select("run_id", F.col("unsettled_calls").alias("calls"), F.col("unsettled_reserved_usd").alias("reserved_usd"))
