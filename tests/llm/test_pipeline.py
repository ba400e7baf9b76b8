import collections
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from memstrata.llm import decontaminate, mixing, queries
from memstrata.session import durable

from .helpers import FOLDER, awkward, documents, empty, groups
from .test_quality import verdicts


def test_stages_against_plain_forms(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = documents(spark)
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(durable(stage(spark, kept[-1], FOLDER)))
    rows = [[r.asDict() for r in k.collect()] for k in kept]
    ids = [collections.Counter(r["doc_id"] for r in x) for x in rows]
    good = verdicts([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows[0]])
    assert set(ids[1]) == {i for i in ids[0] if good[i][0]}
    same = groups([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert set(ids[2]) == {i for i, top in same.items() if i == top}
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    items = decontaminate.Items(bench)
    assert set(ids[3]) == {r["doc_id"] for r in rows[2] if not items.matches(r["text"], 0.5)}
    planned = mixing.plan_mix(kept[3])
    assert ids[4] == collections.Counter({r["doc_id"]: r["copies"] for r in planned.collect() if r["copies"]})
    assert ids[5] == ids[4]
    shards = collections.Counter(r["shard"] for r in rows[5])
    assert max(shards.values()) - min(shards.get(s, 0) for s in range(24)) <= 1
    assert all(k.columns == docs.columns for k in kept[:-1])
    texts = {r["doc_id"]: r["text"] for r in rows[0]}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows[5])


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, FOLDER)
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, FOLDER))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, a.collect())) == sorted(map(key, docs.collect()))


@pytest.mark.parametrize("place", range(5))
def test_every_stage_takes_awkward_and_empty_tables(spark, place):
    _, stage = corpus_pipeline.STAGES[place]
    docs = awkward(spark)
    out = stage(spark, docs, FOLDER)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() >= 0
    assert stage(spark, empty(spark), FOLDER).count() == 0


def test_registered_once_each():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(queries.QUERIES)
    assert "memstrata.llm" in sys.modules
