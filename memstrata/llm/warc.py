"""Content-addressed WARC archive.

A payload is stored once, under its SHA-256, in one table; the exact header
block of every record is kept in another. A record is header and payload
joined by the digest. Digests are verified twice: copies of a payload must
agree in length and SHA-1 when they are stored, and what is read back must
have the digest under which it was stored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memstrata.session import durable, shared_folder

from .common import PIECE_BYTES, slices, table

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_TYPE = "text/html; charset=utf-8"
PACK_LEVEL = 3
RECORD = "record_id long, record_type string, refers_to long, header binary, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 in capitals of 40 hexadecimal digits: each 5 of them are 4 characters."""
    parts = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie."""

    headers: str
    payloads: str


def captures(pages: DataFrame, record_id: str, uri: str, payload: str) -> DataFrame:
    """(record_id, uri, body, address) of each row; a null payload counts as an empty one."""
    kind = dict(pages.dtypes)[payload]
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")) if kind == "binary" else F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8")
    return (pages.select(F.col(f"`{record_id}`").cast("long").alias("record_id"), F.col(f"`{uri}`").cast("string").alias("uri"), body.alias("body"))
            .withColumn("address", F.unhex(F.sha2("body", 256))))


def store_payloads(taken: DataFrame, path: str) -> None:
    """Write each different payload once: address, length, sha1, packed bytes.

    Payloads are packed before they are exchanged, and copies are combined in
    each task first, so a payload of a third of all records is sent once by a
    task. Differing copies under one address stop the job.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        packer = zstandard.ZstdCompressor(level=PACK_LEVEL)
        for whole in batches:
            for batch in slices(whole, "body"):
                yield pa.RecordBatch.from_arrays([
                    batch.column("address"), batch.column("length"), batch.column("sha1"),
                    pa.array([packer.compress(b.as_buffer()) for b in batch.column("body")], pa.binary())],
                    names=["address", "length", "sha1", "packed"])

    facts = taken.select("address", F.octet_length("body").cast("long").alias("length"), F.sha1("body").alias("sha1"), "body")
    packed = facts.mapInArrow(pack, "address binary, length long, sha1 string, packed binary")
    once = packed.groupBy("address").agg(F.min("length").alias("length"), F.max("length").alias("longest"), F.min("sha1").alias("sha1"),
                                         F.max("sha1").alias("other"), F.first("packed").alias("packed"))
    same = (F.col("length") == F.col("longest")) & (F.col("sha1") == F.col("other"))
    (once.select(F.when(same, F.col("address")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary")).alias("address"),
                 "length", "sha1", "packed").write.option("compression", "none").parquet(path))


def write_archive(pages: DataFrame, path: str | None = None, record_id: str = "page_id", uri: str = "url", payload: str = "html",
                  least_bytes: int = 0, date: str = DATE) -> Archive:
    """Archive one record per row.

    Of the records with equal payloads of ``least_bytes`` or more, that with
    the largest id (null is the smallest; equal ids: the greatest URI, and of
    equal rows any one) is the response, and the others are revisits that
    refer to it. Smaller payloads are all responses. Null payloads are empty
    payloads, and equal like any other; a null URI leaves its header line
    out; line breaks in a URI are escaped. Repeated rows are records of their
    own. Other columns are not read, whatever their names. An empty table
    gives an empty archive.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/memstrata/{spark.sparkContext.applicationId}/archive-{uuid.uuid4().hex}"
    archive = Archive(f"{path}/headers", f"{path}/payloads")
    taken = captures(pages, record_id, uri, payload)
    store_payloads(taken, archive.payloads)
    # records without their payloads; the written table fixes the row numbers
    records = durable(taken.select("record_id", "uri", "address", F.octet_length("body").cast("long").alias("length"),
                                   base32_of_hex(F.sha1("body")).alias("digest"), F.monotonically_increasing_id().alias("row")))
    groups = (records.where(F.col("length") >= least_bytes).groupBy("address")
              .agg(F.max(F.struct("record_id", "uri", "row")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("address", "kept"))
    marked = records.join(groups, "address", "left")
    revisit = F.col("kept").isNotNull() & (F.col("kept.row") != F.col("row"))
    name = lambda i: F.concat(F.lit("<urn:record:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("record_id"))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("kept.record_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit(BLOCK_TYPE)), line("Content-Length", F.when(revisit, 0).otherwise(F.col("length")).cast("string")), F.lit("\r\n"))
    (marked.select("record_id", F.encode(header, "UTF-8").alias("header"), "address")
     .write.option("compression", "zstd").parquet(archive.headers))
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record_id, record_type, refers_to, header, payload) of each record, rebuilt from the two tables.

    Types and references are read from the headers. A revisit has the
    payload of the record that it refers to. A record without its payload,
    or a payload whose bytes do not have its digests, stops the job.
    """
    headers = spark.read.schema("record_id long, header binary, address binary").parquet(archive.headers)
    payloads = spark.read.schema("address binary, length long, sha1 string, packed binary").parquet(archive.payloads)
    joined = headers.join(payloads, "address", "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c) for c in ("record_id", "header", "address", "packed", "length", "sha1"))):
                number, header, address, packed, length, sha1 = (x.as_py() for x in row)
                if packed is None:
                    raise ValueError("a record has no payload in the archive")
                body = unpacker.decompress(packed, max_output_size=length) if length else b""
                if hashlib.sha256(body).digest() != address or len(body) != length or hashlib.sha1(body).hexdigest() != sha1:
                    raise ValueError("a payload differs from its digest")
                fields = dict(x.split(": ", 1) for x in header.decode().split("\r\n")[1:] if x)
                target = fields.get("WARC-Refers-To", "<urn:record:none>")[len("<urn:record:"):-1]
                out.append((number, fields["WARC-Type"], None if target == "none" else int(target), header, body))
                held += length
                if held > PIECE_BYTES:
                    yield _records(out)
                    out, held = [], 0
            if out:
                yield _records(out)

    return joined.select("record_id", "header", "address", "packed", "length", "sha1").mapInArrow(rebuild, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["record_id", "record_type", "refers_to", "header", "payload"])


def warc_bytes(records: DataFrame) -> DataFrame:
    """(record_id, record): the record as it stands in a WARC file; a revisit has an empty block there."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("record_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    records = read_archive(spark, write_archive(table(spark, folder, "pages")))
    return records.select(F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                          base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")


OP11_SQL = """
WITH body AS (SELECT page_id, coalesce(url, '') AS url, url IS NULL AS no_url, coalesce(html, '') AS html FROM pages),
named AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
         row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, no_url, url DESC) AS nth,
         max(page_id) OVER (PARTITION BY html) AS kept
  FROM body)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)),
         lambda a, b: a || b) AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN kept END AS refers_to
FROM named
"""
