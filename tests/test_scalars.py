import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memstrata.config import EngineConfig, ModelPrice, price_table
from memstrata.functions import scalars as S
from memstrata.operators import snapshot
from memstrata.sources import archive, dataset, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_utf16_length_counts_surrogate_pairs(spark):
    assert one(spark, S.utf16_length(F.lit("한글원문"))) == 4
    assert one(spark, S.utf16_length(F.lit("한😀글"))) == 4


def test_input_bounds_at_the_limit(spark):
    df = spark.createDataFrame([(1, "한😀글"), (2, "한😀글x"), (3, " \t\n"), (4, "　"), (5, "")], "id int, raw string")
    got = {r.id: r.reason for r in snapshot.input_bounds(df, "raw", 4).collect()}
    assert got == {1: None, 2: "too_long", 3: "blank", 4: "blank", 5: "blank"}


def test_query_terms_keep_case_and_cap(spark):
    text = "a_b Foo foo foo \"OR\" NEAR(x) " + " ".join(f"t{i}" for i in range(100))
    got = one(spark, S.query_terms(F.lit(text)))
    assert got[:6] == ["a_b", "Foo", "foo", "OR", "NEAR", "x"] and len(got) == 64


def test_fold_strips_diacritics(spark):
    assert one(spark, S.index_tokens(F.lit("Éa-ñ_Ü1 한글"))) == ["ea", "n", "u1", "한글"]


def test_cosine_rejects_bad_vectors(spark):
    for bad in ("array(0f, 0f)", "array(1f)", "array(float('nan'), 1f)"):
        with pytest.raises(PySparkException):
            spark.range(1).select(S.cosine(F.expr(bad), F.expr("array(1f, 2f)"))).collect()
    assert one(spark, S.cosine(F.expr("array(1f, 0f)"), F.expr("array(1f, 1f)"))) == pytest.approx(2 ** -0.5)


def test_day_start_skips_a_missing_midnight(spark):
    start = one(spark, S.local_day_start(F.lit("2018-11-04").cast("date"), "America/Sao_Paulo"))
    assert start == dt.datetime(2018, 11, 4, 3, 0)


def test_dataset_timestamp(spark):
    assert one(spark, S.dataset_timestamp(F.lit("2023/05/20 (Sat) 02:21"))) == dt.datetime(2023, 5, 20, 2, 21)
    for wrong in ("tomorrow", "2023/05/20 02:21", "2023/05/20 (Sun) 02:21", "2023/13/20 (Sat) 02:21"):
        with pytest.raises(PySparkException):
            one(spark, S.dataset_timestamp(F.lit(wrong)))


def test_long_context_price_covers_the_whole_request(spark):
    prices = price_table(spark, [ModelPrice("m", Decimal("2"), Decimal("0.2"), Decimal("2.5"), Decimal("10"), 1000, Decimal("2"), Decimal("1.5"))])
    calls = spark.createDataFrame([("m", 1000, 100, 0, 10), ("m", 1001, 100, 0, 10), ("m", 5, 4, 2, 1)], "model string, i long, c long, w long, o long")
    got = calls.join(prices, "model").select("i", S.token_cost(F.col("i"), F.col("c"), F.col("w"), F.col("o"), F.col).alias("x"))
    got = {r.i: r.x for r in got.collect()}
    assert got[1000] == Decimal("0.00192") and got[5] is None
    assert got[1001] == (Decimal(901) * 2 + Decimal(100) * Decimal("0.2")) * 2 / 10**6 + Decimal(10) * 10 * Decimal("1.5") / 10**6


def test_carry_key_keeps_colons(spark):
    key = F.lit("carry:12:abstract:mem:1")
    assert one(spark, S.carry_run(key)) == 12 and one(spark, S.carry_original_key(key)) == "abstract:mem:1"
    assert one(spark, S.carry_malformed(F.lit("carry:x:y")))


def test_rate_is_null_without_denominator(spark):
    assert one(spark, S.rate(F.lit(1), F.lit(0))) is None


def test_root_threshold(spark):
    assert [one(spark, S.root_threshold(3, F.lit(d))) for d in (0, 1, 5)] == [1, 3, 243]
    assert one(spark, S.root_threshold(3, F.lit(500))) >= 10 ** 30


def test_json_merge_replaces_whole_values(spark):
    got = one(spark, S.json_shallow_merge(F.lit('{"a":[1,2],"b":1}'), F.lit('{"a":[3],"c":null}')))
    assert got == {"a": "[3]", "b": "1", "c": None}


def test_unknown_question_type_is_an_error(spark):
    assert one(spark, S.judge_prompt_route(F.lit("zzz"), F.lit("q_abs"), ["a"])) == "abstention"
    with pytest.raises(PySparkException):
        one(spark, S.judge_prompt_route(F.lit("zzz"), F.lit("q"), ["a"]))


def test_config_rules():
    with pytest.raises(ValueError):
        EngineConfig(root_base=1)
    assert EngineConfig.evaluation().recall_limit == 5


def test_browse_is_literal_and_case_sensitive(spark):
    m = spark.createDataFrame([(1, "m1", 0, "100% sure", "s", 0, True), (2, "m2", 0, "100x sure", "s", 0, True), (3, "m3", 0, "SURE", "s", 0, True)],
                              "seq long, id string, depth int, content string, source_ref string, dream_revision long, sealed boolean")
    assert [r.id for r in snapshot.browse(m, search="0% s").collect()] == ["m1"]
    assert {r.id for r in snapshot.browse(m, search="sure").collect()} == {"m1", "m2"}
    with pytest.raises(ValueError):
        snapshot.browse(m, search="x" * 201)
    with pytest.raises(ValueError):
        snapshot.page_of(m, [F.col("seq")], 0)


def test_archive_keeps_the_body_exactly(spark, tmp_path):
    raw = "  lead\n---\n\ninner \n"
    src = spark.createDataFrame([(raw,)], "raw string").select(
        S.content_id(F.col("raw")).alias("id"), S.content_hash(F.col("raw")).alias("content_hash"),
        F.lit("2026-01-02 03:04:05").cast("timestamp").alias("created_at"), "raw")
    files = archive.archive_text(src).withColumn("relative_path", S.relative_path(F.col("content_hash"), F.col("created_at")))
    archive.write_archive(files, str(tmp_path))
    broken = tmp_path / "sources" / "src_bad.md"
    broken.write_bytes(b"\xff\xfe---")
    rows = {r.relative_path: r for r in archive.scan_archive(spark, str(tmp_path)).collect()}
    good = [r for r in rows.values() if r.valid]
    assert len(rows) == 2 and good[0].raw == raw and good[0].created_at == dt.datetime(2026, 1, 2, 3, 4, 5)
    assert rows["sources/src_bad.md"].error_class == "DecoderFallbackException"


def test_register_is_byte_exact_and_order_free(spark):
    rows = [(1, "a", "2026-01-02"), (2, "a ", "2026-01-01"), (3, "a", "2026-01-01"), (4, "A", "2026-01-01")]
    for order in (rows, rows[::-1]):
        calls = spark.createDataFrame(order, "call_id long, raw string, at string").withColumn("at", F.col("at").cast("timestamp"))
        new, results = archive.register_sources(calls)
        assert new.count() == 3
        assert {r.call_id: r.new_source for r in results.collect()} == {1: False, 2: True, 3: True, 4: True}


def test_dataset_array_file(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"question_id":"q1","question_type":"t","question":"?","answer":5,"question_date":"2023/05/20 (Sat) 02:21",'
                    '"answer_session_ids":["s2"],"haystack_dates":["2023/05/20 (Sat) 02:21","2023/05/19 (Fri) 02:21"],'
                    '"haystack_session_ids":["s1","s2"],"haystack_sessions":[[{"role":"user","content":"x","has_answer":true}],[{"role":"user","content":"x"}]]}]')
    q, s = dataset.load_dataset(spark, str(path))
    rows = {r.session_id: r for r in s.collect()}
    assert q.first().answer == "5" and "has_answer" not in rows["s1"].raw and "s1" not in rows["s1"].raw
    assert rows["s1"].raw != rows["s2"].raw


def test_unequal_arrays_fail(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"question_id":"q1","haystack_dates":[],"haystack_session_ids":["s1"],"haystack_sessions":[[]]}]')
    with pytest.raises(PySparkException):
        dataset.load_dataset(spark, str(path))[0].collect()


def test_cache_computes_each_missing_key_once(spark):
    inputs = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k2")], "id int, key string")
    cache = spark.createDataFrame([("k1", 10)], "cache_key string, result int")
    asked = []

    def compute(missing):
        asked.extend(r.cache_key for r in missing.collect())
        return missing.select("cache_key", F.lit(7).alias("result"))
    out, grown = vectors.enrich_through_cache(inputs, "key", cache, compute)
    assert asked == ["k2"] and grown.count() == 2
    assert {r.id: r.result for r in out.collect()} == {1: 10, 2: 7, 3: 7}
