import base64
import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from memstrata.llm import warc
from suite.check import compare, connect

from .helpers import FOLDER, LONG

ROWS = [(1, "http://a/1", "<p>é 😀</p>"), (2, "http://a/2", "<p>é 😀</p>"), (2, "http://a/2", "<p>é 😀</p>"), (None, "http://a/3", "<p>é 😀</p>"),
        (3, None, None), (4, "http://a/\r\nX: y", ""), (None, None, None), (5, "http://b", LONG), (6, "http://c", "<p>é 😀</p> "), (-7, "http://b", LONG)]
NAMES = ["address", "record_id", "body", "digest", "row", "kept", "length", "header", "payload"]


def pages(spark):
    schema = "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in ROWS], schema)


def plain(rows, least=0):
    """(id, type, refers to, payload) of each row, one row of a group being the response."""
    groups = collections.defaultdict(list)
    for i, url, html in rows:
        groups[html or ""].append((i, url))
    out = []
    for html, members in groups.items():
        top = max(range(len(members)), key=lambda k: (members[k][0] is not None, members[k][0] or 0, members[k][1] is not None, members[k][1] or ""))
        for k, (i, _) in enumerate(members):
            alone = len(html.encode()) < least or k == top
            out.append((i, "response" if alone else "revisit", None if alone else members[top][0], html.encode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 40])
def test_records_come_back(spark, least):
    archive = warc.write_archive(pages(spark), least_bytes=least)
    got = warc.read_archive(spark, archive).collect()
    assert sorted([(r.record_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got], key=repr) == plain(ROWS, least)
    # each payload lies there once
    assert spark.read.parquet(archive.payloads).count() == len({r[2] or "" for r in ROWS})


def test_headers_are_whole(spark):
    records = warc.read_archive(spark, warc.write_archive(pages(spark)))
    whole = [bytes(r.record) for r in warc.warc_bytes(records).collect()]
    assert len(whole) == len(ROWS)
    for record, r in zip(whole, records.collect()):
        head, block = record.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) - 4
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"
        assert "X" not in fields


def test_changed_payload_is_found(spark):
    archive = warc.write_archive(pages(spark))
    good = spark.read.parquet(archive.payloads)
    bad = archive.payloads + "-bad"
    good.withColumn("sha1", F.lit("00")).write.parquet(bad)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, warc.Archive(archive.headers, bad)).collect()
    good.limit(1).write.parquet(bad + "2")
    with pytest.raises(Exception, match="no payload"):
        warc.read_archive(spark, warc.Archive(archive.headers, bad + "2")).collect()


def test_empty_table(spark):
    assert warc.read_archive(spark, warc.write_archive(pages(spark).limit(0))).count() == 0


def test_query(spark):
    assert compare(warc.op11(spark, FOLDER), connect(FOLDER), warc.OP11_SQL) is None
