"""What stored tables hold and how they are packed."""

import os

from memstrata.session import durable
from memstrata.sources.corpus import Corpus

FOLDER = "/root/testdata/sf0.001"


def test_stored_tables_are_packed_closely(spark):
    assert all(f.endswith(".zstd.parquet") for f in durable(spark.range(10)).inputFiles())


def test_contents_are_stored_twice_at_most(spark):
    c = Corpus.of(spark, FOLDER)
    assert c.memories.count() == c.base_memories.count() and c.postings.select("term").distinct().count() == c.frequencies.count()
    held = {name for name in os.listdir(c.space.root.removeprefix("file:")) if "content" in spark.read.parquet(f"{c.space.root}/{name}").columns}
    assert held == {"observations", "memories"}
    assert not os.path.exists(f"{c.space.root.removeprefix('file:')}/postings")


def test_queries_without_contents_move_none(spark, tmp_path):
    import __spark_entry__
    QUERIES = __spark_entry__.queries()
    for name in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    c = Corpus.of(spark, str(tmp_path))
    for name in ("corpus_overview", "recall_history_apply", "relation_category", "work_identity"):
        assert QUERIES[name](spark, str(tmp_path)).count()
    held = {name for name in os.listdir(c.space.root.removeprefix("file:")) if "content" in spark.read.parquet(f"{c.space.root}/{name}").columns}
    assert not held
    assert c.memory_rows.exceptAll(c.memories.drop("content")).isEmpty() and c.memories.drop("content").exceptAll(c.memory_rows).isEmpty()


def test_searches_and_single_readings_store_no_content(spark, tmp_path):
    import __spark_entry__
    from memstrata.sources.corpus import memory_id
    QUERIES = __spark_entry__.queries()
    for name in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    c = Corpus.of(spark, str(tmp_path))
    for name in ("hybrid_search", "retrieval_metrics", "evidence_coverage", "recall", "allowed_set_semi_join", "late_content_fetch"):
        assert QUERIES[name](spark, str(tmp_path)).count()
    held = set(os.listdir(c.space.root.removeprefix("file:")))
    assert "shards" in held and not held & {"memories", "observations", "embeddings", "frequencies"}
    texts, vectors = c.memory_texts, c.memory_vectors
    some = c.base_places.select(memory_id().alias("id")).filter("crc32(id) % 3 = 0").distinct()
    chosen = c.contents_of(some)
    stored = c.memories.select(*texts.columns)
    assert not held & {"memories"} and texts.exceptAll(stored).isEmpty() and stored.exceptAll(texts).isEmpty()
    assert vectors.exceptAll(c.embeddings).isEmpty() and c.embeddings.exceptAll(vectors).isEmpty()
    want = stored.select("id", "content").join(some, "id", "left_semi")
    assert chosen.exceptAll(want).isEmpty() and want.exceptAll(chosen).isEmpty()


def test_a_call_listed_twice_has_each_line_twice(spark, tmp_path):
    long = "x" * 4000 + "yz"
    documents = [(2, "a\n\nb"), (2, "a\n\nb"), (3, long), (4, "a\n\nb"), (50, "failed"), (5, None), (7, " ")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    c = Corpus.of(spark, str(tmp_path))
    rows = c.memories.orderBy("seq").collect()
    assert [r.content for r in rows if r.depth == 0] == ["a", "a", "b", "b", "x" * 4000, "yz"]
    assert [(r.seq, r.id, r.content) for r in rows if r.depth > 0] == [(7, "mem_d1_0", "Pattern 0 a")]
    assert sorted(r.seq for r in rows) == list(range(1, 8))


def test_texts_meet_in_shards_before_they_are_split(spark):
    from memstrata.operators import shards
    memories = spark.createDataFrame([("m1", 1, 0, "one two"), ("m2", 2, 0, None), ("m3", 5000, 1, "two")], "id string, seq long, depth int, content string")
    built = shards.build_shards(memories)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("AS tokens") < plan.index("RepartitionByExpression")
    assert {r.shard: sorted(r.memories) for r in built.collect()} == {0: ["m1"], 1: ["m3"]}


def test_places_hold_hashes_as_bytes(spark):
    c = Corpus.of(spark, FOLDER)
    assert dict(c.memory_places.dtypes)["hash"] == "binary" and "content_hash" not in c.memory_places.columns
    named = {r.id for r in c.sources.collect()}
    rows = c.memory_rows.filter("depth = 0").collect()
    assert rows and all(r.source_ref in named and r.id.startswith(f"mem_{r.source_ref[4:28]}_") for r in rows)


def test_gold_and_ranked_sessions_shuffle_no_corpus(spark, tmp_path):
    import __spark_entry__
    for name in os.listdir(FOLDER):
        os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    assert __spark_entry__.queries()["retrieval_metrics"](spark, str(tmp_path)).count()
    stored = os.listdir(Corpus.of(spark, str(tmp_path)).space.root.removeprefix("file:"))
    assert "ranked_sessions" in stored and "memory_roots" not in stored
