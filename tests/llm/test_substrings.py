import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memstrata.llm import substrings

from .helpers import FOLDER, awkward, documents, empty


def brute(rows):
    """(doc_id -> removed mask) by a set of all runs of smaller documents."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if b[k:k + 50] in seen:
                gone[k:k + 50] = True
        out[i] = gone
        seen.update(b[k:k + 50] for k in range(len(b) - 49))
    return out


def same(rows, got):
    want = brute(rows)
    for i, t in rows:
        b, gone, r = (t or "").encode(), want[i], got[i]
        assert r.n_bytes == len(b)
        assert bytes(r.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes(), i
        assert sum(s.end - s.start for s in r.removed) == gone.sum()
        assert all(gone[s.start:s.end].all() for s in r.removed) and len(r.removed) == int((np.diff(np.r_[0, gone]) == 1).sum())


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    want = brute(rows)
    texts = dict(rows)
    for r in substrings.op6(spark, FOLDER).collect():
        gone, b = want[r.doc_id], np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), gone.sum(), (np.diff(np.r_[0, gone]) == 1).sum())
        assert r.kept_sha256 == hashlib.sha256(b[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("parts", [1, 6])
def test_shared_pieces_at_all_lengths_and_places(spark, parts):
    r = random.Random(parts)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    pieces = [word(n) for n in (49, 50, 51, 70, 99, 100, 101, 300)] + ["a" * 120, "ab" * 70, "é" * 40, "\x00" * 60]
    rows = []
    for i in range(120):
        t = "".join(r.choice([word(r.randint(0, 60)), r.choice(pieces), r.choice(pieces)[: r.randint(1, 300)]]) for _ in range(r.randint(0, 6)))
        rows.append((i * 3 - 50, t))
    rows += [(1000, rows[5][1]), (1001, rows[5][1] + "x"), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    same(rows, {x.doc_id: x for x in substrings.find_repeats(docs).collect()})


def test_awkward_rows(spark):
    got = substrings.find_repeats(awkward(spark)).collect()
    assert len(got) == 15
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert not by[1][0].removed and all(x.removed[0].end == x.n_bytes and not x.kept for x in by[2])
    assert sorted((x.n_bytes, len(x.removed)) for x in by[None]) == [(0, 0), (by[1][0].n_bytes, 1)]
    assert by[6][0].removed == [] and len(by[10][0].removed) == 1
    assert substrings.find_repeats(empty(spark)).count() == 0


def test_rows_of_one_id_do_not_touch_each_other(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(90))
    docs = spark.createDataFrame([(5, text), (5, text), (5, text + "!"), (None, "?" + text)], "doc_id long, text string")
    got = substrings.find_repeats(docs).collect()
    assert [len(x.removed) for x in got if x.doc_id == 5] == [0, 0, 0]
    assert [len(x.removed) for x in got if x.doc_id is None] == [1]


def test_anchors_do_not_depend_on_segments(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 1500, 1500, 1549, 1600, 5000], np.int64)
    whole = np.concatenate([a for a, _ in substrings.anchors(data, offsets)])
    monkeypatch.setattr(substrings, "SEGMENT", 97)
    cut = np.concatenate([a for a, _ in substrings.anchors(data, offsets)])
    assert whole.tolist() == cut.tolist()
    h = substrings.names(data)
    want = set()
    for a, b in zip(offsets, offsets[1:]):
        for w in range(a, b - 49):
            part = h[w:w + 31] >> np.uint64(32)
            want.add(int(w + np.argmin(part)))
    assert set(whole.tolist()) == want


def test_names_are_functions_of_their_bytes():
    data = np.frombuffer(b"0123456789abcdefghijXXXXX0123456789abcdefghij", np.uint8)
    h = substrings.names(data)
    assert h[0] == h[25] and len(set(h.tolist())) == len(h) - 1


def test_packed_round_trip():
    at, raw = np.array([0, 5, 5, 1 << 40], "<u8"), np.arange(320, dtype=np.uint8).reshape(4, 80)
    back = substrings.unpacked(substrings.packed(at=at, around=raw), at="<u8", around="V80")
    assert back["at"].tolist() == at.tolist() and (back["around"].view(np.uint8).reshape(4, 80) == raw).all()


def test_places_of_a_common_line_are_spread(spark):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    line, buckets = word(70), 16
    rows = [(i, f"{word(60)} {line} {word(60)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    keyed = docs.withColumns({"join_key": F.col("doc_id"), "text_key": F.xxhash64("text")})

    def spread(sent, **kinds):
        n = np.zeros(buckets, int)
        for x in sent.where("kind = 1").collect():
            n[x.bucket] += len(substrings.unpacked(bytes(x.data), **kinds)["at"])
        return n

    named = spread(substrings.named_anchors(keyed, buckets), join="<i8", more="<i8", at="<u8")
    assert named.sum() >= 600 and named.max() <= 3 * named.mean()
    same_around = docs.withColumns({"text": F.lit(line), "text_key": F.xxhash64(F.lit(line)), "places": F.array(F.lit(20))})
    around = spread(substrings.sent_contexts(same_around, buckets), id="<i8", key="<i8", at="<u8", mask="<u4")
    assert around.sum() >= 500 and around.max() <= 3 * around.mean()
    same(rows, {x.doc_id: x for x in substrings.find_repeats(docs).collect()})
