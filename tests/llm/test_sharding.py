import collections
import zlib

import numpy as np

from memstrata.llm import sharding

from .helpers import FOLDER, awkward, documents, empty


def test_fisher_yates_is_a_uniform_permutation():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(i))) for i in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
    assert list(sharding.fisher_yates(0, np.random.default_rng(0))) == []
    assert list(sharding.fisher_yates(1, np.random.default_rng(0))) == [0]


def check_law(places, n, shards):
    by = collections.defaultdict(list)
    for shard, slot in places:
        by[shard].append(slot)
    counts = [len(by[s]) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark):
    rows = sharding.op10(spark, FOLDER).collect()
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    check_law([(r.shard, r.slot) for r in rows], len(docs), 24)
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)


def test_several_buckets_keep_every_record(spark):
    docs = documents(spark)
    out = sharding.shuffle_shards(docs, shards=7, bucket_bytes=40_000)
    rows = out.collect()
    check_law([(r.shard, r.slot) for r in rows], docs.count(), 7)
    assert sorted(map(tuple, docs.collect())) == sorted(tuple(r)[:-2] for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = sharding.shuffle_shards(docs, shards=4)
    assert out.columns == [*docs.columns, "_shard", "_slot"]
    rows = out.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(key(r) for r in docs.collect()) == sorted(key(tuple(r)[:-2]) for r in rows)
    check_law([(r._shard, r._slot) for r in rows], len(rows), 4)
    assert sharding.shuffle_shards(empty(spark)).count() == 0


def test_fewer_rows_than_shards(spark):
    rows = sharding.shuffle_shards(documents(spark).limit(3)).collect()
    assert len({r.shard for r in rows}) == 3 and {r.slot for r in rows} == {0}
