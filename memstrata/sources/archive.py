"""Source registry: archive scan, exact-content registration, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


SMALL_FILE_COST = 64 * 1024    # what opening a file counts when files are dealt to tasks


def small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one whose scans put many small files into a task.

    Spark counts four megabytes for each file it opens, so texts of some kilobytes would
    make a task of every few of them, which the driver cannot hold for a large archive.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.openCostInBytes", SMALL_FILE_COST)
    return own


def scan_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``src_*.md`` file; the body stays byte-exact.

    Files are read as bytes, so an undecodable file becomes a row with an
    error class instead of failing the job.
    """
    files = (small_files(spark).read.format("binaryFile")
             .option("pathGlobFilter", "src_*.md").option("recursiveFileLookup", "true")
             .load(folder).select("path", "content"))
    decodable = F.expr("is_valid_utf8(content)")
    text = F.when(decodable, F.col("content").cast("string"))
    end = F.locate("\n---\n\n", F.col("text"))
    framed = F.col("text").startswith("---\n") & (end > 0)
    header = F.when(framed, F.substring(F.col("text"), F.lit(5), end - F.lit(5) + F.lit(0)))
    body = F.when(framed, F.substring(F.col("text"), end + F.lit(6), F.length("text")))
    # "key: value" lines; only the first ": " separates
    fields = F.map_from_entries(F.transform(
        F.filter(F.split(header, "\n"), lambda line: F.locate(": ", line) > 0),
        lambda line: F.struct(
            F.substring_index(line, ": ", 1).alias("key"),
            F.substring(line, F.locate(": ", line) + F.lit(2), F.length(line)).alias("value"))))
    parsed = (files.withColumn("text", text)
              .withColumn("fields", F.when(framed, fields))
              .withColumn("raw", body))
    digest = S.content_hash(F.col("raw"))
    claimed = F.col("fields")["content_sha256"]
    header_ok = F.col("fields").isNotNull() & claimed.isNotNull() & F.col("fields")["id"].isNotNull()
    return parsed.select(
        F.col("fields")["id"].alias("id"),
        claimed.alias("content_hash"),
        F.regexp_extract("path", r"(sources/.*)$", 1).alias("relative_path"),
        F.try_to_timestamp(F.col("fields")["created_at"]).alias("created_at"),
        "raw",
        F.coalesce(header_ok & (digest == claimed)
                   & (F.col("fields")["id"] == F.concat(F.lit("src_"), digest)), F.lit(False)).alias("valid"),
        F.when(~decodable, F.lit("DecoderFallbackException")).alias("error_class"),
        F.coalesce(header_ok, F.lit(False)).alias("header_ok"),
        F.coalesce(digest == claimed, F.lit(False)).alias("hash_ok"),
    )


def archive_text(sources_with_raw: DataFrame) -> DataFrame:
    """The archive file body of each source as one text value."""
    return sources_with_raw.select("id", "content_hash", "created_at", F.concat(
        F.lit("---\nid: "), F.col("id"), F.lit("\ncontent_sha256: "), F.col("content_hash"),
        F.lit("\ncreated_at: "), S.iso_utc(F.col("created_at")), F.lit("\n---\n\n"), F.col("raw"),
    ).alias("text"))


def resolved(spark, folder: str) -> str:
    """A path without a scheme as the session's default file system has it; a local one only under a local master."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if not default.startswith("file:"):
        return default.rstrip("/") + folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name the scheme of a file system that all executors share")
    return folder


def write_archive(archived: DataFrame, folder: str) -> None:
    """One Markdown file per source below the shared folder.

    ``archived(relative_path, text)``. The path holds the content digest, so a
    repeated task writes the same bytes to the same place.
    """
    folder = resolved(archived.sparkSession, folder)

    def write(rows) -> None:
        import posixpath

        from pyarrow import fs
        target, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        made: set[str] = set()
        for row in rows:
            path = f"{root}/{row.relative_path}"
            parent = posixpath.dirname(path)
            if parent not in made:
                target.create_dir(parent, recursive=True)
                made.add(parent)
            with target.open_output_stream(path) as out:
                out.write(row.text.encode("utf-8"))

    archived.select("relative_path", "text").foreachPartition(write)


def artifact_status(sources: DataFrame, archive: DataFrame, corpus_prefix: str = "sources/") -> DataFrame:
    """Classify registered sources against the archive; sizes only when available."""
    held = archive.select(
        F.col("relative_path").alias("a_path"), F.col("raw").alias("a_raw"),
        F.col("content_hash").alias("a_hash"), "error_class", "header_ok", "hash_ok")
    joined = sources.join(held, sources.relative_path == held.a_path, "left")
    outside = ~F.col("relative_path").startswith(corpus_prefix) | F.col("relative_path").contains("..")
    status = (F.when(outside, "outside_corpus")
              .when(F.col("a_path").isNull(), "missing")
              .when(F.col("error_class").isNotNull(), F.col("error_class"))
              .when(~F.col("header_ok"), "invalid_header")
              .when(~F.col("hash_ok") | (F.col("a_hash") != F.col("content_hash")), "hash_mismatch")
              .otherwise("available"))
    ok = F.col("artifact_status") == "available"
    return (joined.withColumn("artifact_status", status)
            .select(*sources.columns, "artifact_status",
                    F.when(ok, S.utf16_length(F.col("a_raw"))).alias("raw_characters"),
                    F.when(ok, S.utf8_length(F.col("a_raw"))).alias("raw_bytes")))


def register_sources(calls: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact-content dedup of ``calls(call_id, raw, at)``.

    Returns the new registry rows and one result row per call. The raw text
    never travels: only the digest is grouped, and the grouping combines on
    the map side, so a text that is repeated in a third of all calls costs
    one row per task.
    """
    keyed = calls.select("call_id", "at", S.content_hash(F.col("raw")).alias("content_hash"))
    first = (keyed.groupBy("content_hash")
             .agg(F.min(F.struct("at", "call_id")).alias("first")))
    if registry is not None:
        first = first.join(registry.select("content_hash"), "content_hash", "left_anti")
    new_rows = first.select(
        F.concat(F.lit("src_"), F.col("content_hash")).alias("id"),
        "content_hash",
        S.relative_path(F.col("content_hash"), F.col("first.at")).alias("relative_path"),
        F.col("first.at").alias("created_at"),
        F.lit("pending").alias("status"),
        F.col("first.call_id").alias("first_call_id"),
    )
    # A call is new exactly when it is the first of a new digest, so the
    # per-call flag is a join on the unique call id and not on the digest.
    winners = new_rows.select(F.col("first_call_id").alias("call_id"), F.lit(True).alias("won"))
    results = (keyed.join(winners, "call_id", "left")
               .select("call_id", F.concat(F.lit("src_"), F.col("content_hash")).alias("source_id"),
                       F.coalesce("won", F.lit(False)).alias("new_source")))
    return new_rows, results


def recover_sources(archive: DataFrame, sources: DataFrame) -> DataFrame:
    """Unregistered archive rows become pending; interrupted work is pending again."""
    orphans = (archive.filter("valid").select("id", "content_hash", "relative_path", "created_at")
               .join(sources.select("id"), "id", "left_anti")
               .withColumn("status", F.lit("pending")))
    kept = sources.select("id", "content_hash", "relative_path", "created_at",
                          F.when(F.col("status") == "processing", "pending")
                          .otherwise(F.col("status")).alias("status"))
    return kept.unionByName(orphans)


def first_source_at(sources: DataFrame) -> DataFrame:
    return sources.agg(F.min("created_at").alias("first_source_at"))


def incomplete_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("status").isin("pending", "failed"))
