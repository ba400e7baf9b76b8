import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from memstrata.llm import mixing
from suite.check import compare, connect

from .helpers import FOLDER, awkward, documents, empty


def test_query_matches_sql(spark):
    assert compare(mixing.op1(spark, FOLDER), connect(FOLDER), mixing.OP1_SQL) is None


def test_targets_by_sharing_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, "e": 70, None: 40, "z": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = [*sorted(s for s in sizes if s), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, want, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want.update(share)
            break
        want.update({s: 3.0 * sizes[s] for s in over})
        free -= over
    assert got == pytest.approx(want)


def plain(rows):
    """The copies of each row, in plain Python."""
    size = [len((t or "").replace("\n", " ").replace("\t", " ").split(" ")) if t else 0 for _, t, _ in rows]
    size = [len([w for w in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    return size, total


def test_awkward_rows(spark):
    docs = awkward(spark)
    planned = mixing.plan_mix(docs)
    assert planned.columns[:len(docs.columns)] == docs.columns
    rows = planned.collect()
    assert len(rows) == docs.count()
    size, copies = planned.columns[-4], planned.columns[-1]
    _, total = plain([(r.doc_id, r.text, r.source) for r in docs.collect()])
    for r in rows:
        assert r[planned.columns[-3]] == total[r.source]
        assert 0 <= r[copies] <= 3
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[(r.doc_id, r.source)].add(r[copies])
    assert all(len(v) == 1 for v in by_id.values())
    assert {r[size] for r in rows if r.text is None} == {0}
    again = mixing.plan_mix(docs.repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_empty_table(spark):
    assert mixing.plan_mix(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0


def test_words_come_near_the_targets(spark):
    planned = mixing.plan_mix(documents(spark, "/root/testdata/sf0.1"))
    worst = planned.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"))
    for r in worst.collect():
        assert abs(r.taken - r.target) <= r.largest / 2 + 1


def test_unequal_preferences(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "s" if i % 2 else "t") for i in range(400)], "doc_id long, text string, source string")
    liked = F.when(F.col("doc_id") < 100, 4.0).otherwise(1.0)
    planned = mixing.plan_mix(docs, preference=liked, weights=(1, 3))
    share = planned.groupBy("source", F.col("doc_id") < 100).agg(F.avg("copies").alias("a")).collect()
    got = {(r.source, r[1]): r.a for r in share}
    assert got[("s", True)] > 2 * got[("s", False)]
    sums = {r.source: r.t for r in planned.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect()}
    assert abs(sums["s"] - 1000) <= 5 and abs(sums["t"] - 3000) <= 5


def test_random_number_is_the_hash(spark):
    from memstrata.llm.common import hex_unit
    got = spark.createDataFrame([("7:12",)], "k string").select(hex_unit(F.col("k"))).first()[0]
    assert got == (int(hashlib.md5(b"7:12").hexdigest()[:13], 16) + 0.5) / 2 ** 52


def test_mix_repeats_rows(spark):
    docs = documents(spark)
    planned = mixing.plan_mix(docs)
    assert mixing.mix(docs).count() == planned.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs).columns == docs.columns
