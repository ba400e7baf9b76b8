"""The archive scan deals many small files to few tasks."""

from memstrata.sources import archive


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"src_{i}.md").write_text(f"---\nid: src_{i}\ncontent_sha256: {i}\ncreated_at: 2024-01-01T00:00:00Z\n---\n\ntext {i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        found = archive.scan_archive(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() < 20
        assert sorted((r.id, r.raw) for r in found.collect()) == sorted((f"src_{i}", f"text {i}") for i in range(200))
        assert spark.conf.get("spark.sql.files.openCostInBytes") != str(archive.SMALL_FILE_COST)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_closure_and_applied_abstractions_store_no_contents(spark, tmp_path):
    import os

    import __spark_entry__
    from memstrata.sources.corpus import Corpus
    for name in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    for name in ("report_memory_closure", "apply_embedded_abstractions"):
        assert __spark_entry__.queries()[name](spark, str(tmp_path)).count()
    assert not {"memories", "observations"} & set(os.listdir(Corpus.of(spark, str(tmp_path)).space.root.removeprefix("file:")))
