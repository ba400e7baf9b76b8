import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memstrata.llm import tokens

from .helpers import FOLDER, awkward, documents, empty

FILE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 32), st.data())
def test_packing(width, data):
    values = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=70)), np.uint32)
    raw = tokens.pack(values, width)
    assert len(raw) == (-(-len(values) // 8) * width if width and len(values) else 0)
    assert tokens.unpack(raw, len(values), width).tolist() == values.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), min_size=1, max_size=300), st.integers(1, 100))
def test_blocks(values, percentile):
    ids = np.array(values, np.uint32)
    assert tokens.decode_block(tokens.encode_block(ids, percentile)).tolist() == values


def test_width_is_that_of_the_percentile():
    ids = np.r_[np.full(90, 107), np.full(10, 60_000)].astype(np.uint32)
    assert tokens.HEAD.unpack_from(tokens.encode_block(np.r_[ids, 100].astype(np.uint32), 80)) == (100, 101, 10, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 1 << 40)), st.lists(st.integers(0, 50_256), max_size=60)), max_size=40), st.integers(1, 64))
def test_files(documents_, block):
    sink = io.BytesIO()
    writer = tokens.Writer(sink, block=block)
    for i, ids in documents_:
        writer.add(i, np.array(ids, np.uint32))
    assert writer.close() == sum(len(x) for _, x in documents_)
    data = sink.getvalue()
    at = 0
    for (i, ids), (j, start, got) in zip(documents_, tokens.read_file(io.BytesIO(data), len(data)), strict=True):
        assert (i, at, ids) == (j, start, got.tolist())
        at += len(ids)


def test_a_broken_file_is_refused():
    with pytest.raises(ValueError):
        list(tokens.read_file(io.BytesIO(b"x" * 100), 100))


def test_encoder_equals_the_library(spark):
    r = random.Random(1)
    texts = [x.text for x in documents(spark).collect()]
    parts = [" ", "  ", "\n", "\t", "ab", "é.", "x,", "1.", "..", "'s", "<|endoftext|>", "\x85", "\x1c", " ", "　", "😀", "don't.", "²", "Ⅷ,", "\nab", "ab.\ncd", "x,\ny", "\n\nz", "a.b", "word. ", "é,", "\r\nq", "A" * 70, "\u2003", "\u00a0"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["", " ", "a  b "]
    for most in (1 << 20, 50):                       # a store that is emptied again and again, too
        encoder = tokens.Encoder(FILE, most)
        for _ in range(2):                           # the second time from the store
            for text, ids in zip(texts, encoded(encoder, texts)):
                assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def encoded(encoder, texts):
    parts = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])]
    ids, counts = encoder.encode(np.frombuffer(b"".join(parts), np.uint8), offsets)
    ends = np.cumsum(counts)
    assert len(counts) == len(texts) and ends[-1] == len(ids)
    return [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]


def test_pieces_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "BYTE_HASH", np.ones(256, np.uint64))
    encoder = tokens.Encoder(FILE)
    texts = ["aa bb cc", "bb aa dd ee", "cc x" * 3, "y" * 100 + " " + "z" * 100] * 2
    for _ in range(2):
        for text, ids in zip(texts, encoded(encoder, texts)):
            assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def plain(rows):
    from tokenizers import Tokenizer
    tokenizer, start = Tokenizer.from_file(FILE), 0
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_query(spark):
    got = sorted(map(tuple, tokens.op7(spark, FOLDER).collect()))
    assert got == list(plain([(r.doc_id, r.text) for r in documents(spark).collect()]))


def test_several_files(spark, tmp_path):
    docs = documents(spark)
    manifest = tokens.write_ids(docs, FILE, path=str(tmp_path / "ids"), file_bytes=60_000)
    assert len(manifest) > 3
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokens.read_ids(spark, manifest).collect())
    assert got == list(plain([(r.doc_id, r.text) for r in docs.collect()]))


def test_awkward_rows(spark):
    rows = tokens.read_ids(spark, tokens.write_ids(awkward(spark), FILE)).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None, None, 1, 2, 2, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10]
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])[:-1]].tolist()
    assert next(r for r in rows if r.doc_id == 3).n_tokens == 1
    assert tokens.read_ids(spark, tokens.write_ids(empty(spark), FILE)).count() == 0


def test_many_rows_of_one_id_are_split(spark):
    docs = spark.createDataFrame([(None, f"text {i} " * 20) for i in range(300)] + [(1, "x")], "doc_id long, text string")
    manifest = tokens.write_ids(docs, FILE, file_bytes=8_000)
    assert len(manifest) > 3 and max(m[2] for m in manifest) < 200
    assert tokens.read_ids(spark, manifest).count() == 301
