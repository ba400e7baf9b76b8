import random
import zlib

import numpy as np
import pytest

from memstrata.llm import toxicity

from .helpers import awkward, documents, empty


def test_nearest_are_exact():
    r = random.Random(1)
    idf = np.array([r.uniform(0.5, 4) for _ in range(40)])
    rows = []
    for i in range(700):
        terms = sorted(r.sample(range(40), r.randint(1, 6)))
        rows.append((i, r.randint(0, 1), terms, [r.randint(1, 5) for _ in terms]))
    index = toxicity.Index(rows, idf, neighbours=9)
    by_id = {x[0]: x for x in rows}
    dense = np.zeros((len(rows), 40))
    for n, i in enumerate(index.ids):
        dense[n, by_id[i][2]] = index.weights(by_id[i][2], by_id[i][3])
    for _ in range(150):
        terms = sorted(r.sample(range(40), r.randint(1, 6)))
        counts = [r.randint(1, 5) for _ in terms]
        q = np.zeros(40)
        q[terms] = index.weights(terms, counts)
        scores = dense @ q
        at, near = index.nearest(terms, counts)
        want = np.sort(scores[scores > 0])[::-1][:9]
        assert near == pytest.approx(want, abs=1e-9)
        assert scores[at] == pytest.approx(near, abs=1e-9)
    assert index.visited < 150 * len(index.largest[0])          # blocks were skipped


def test_calibration_rises():
    r = np.random.default_rng(2)
    x = np.round(r.random(500), 2)
    ends, means = toxicity.rising(x, (r.random(500) < x).astype(float))
    assert (np.diff(ends) > 0).all() and len(ends) < 60
    assert abs(means[np.searchsorted(ends, 0.9)] - 0.9) < 0.15 and abs(means[np.searchsorted(ends, 0.1)] - 0.1) < 0.15


@pytest.mark.parametrize(("folder", "least"), [("/root/testdata/sf0.01", 0.7), ("/root/testdata/sf0.1", 0.88)])
def test_held_out_accuracy(spark, folder, least):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = toxicity.op2(spark, folder).collect()
    assert len(rows) == documents(spark, folder).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    found, all_toxic = sum(t and p for t, p in held), sum(t for t, _ in held)
    wrong, clean = sum(p and not t for t, p in held), sum(not t for t, _ in held)
    assert found >= least * all_toxic and wrong <= 0.01 * clean


def test_held_out_labels_are_not_used(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet").collect()
    turned = [(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in labels]
    frames = [spark.createDataFrame(x, "doc_id long, toxic int") for x in ([(r.doc_id, r.toxic) for r in labels], turned)]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, f).collect()) for f in frames)
    assert a == b


def test_equal_texts_have_equal_scores(spark):
    rows = {}
    folder = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in documents(spark, folder).collect()}
    for r in toxicity.op2(spark, folder).collect():
        rows.setdefault(text[r.doc_id], set()).add(r.score)
    assert all(len(v) == 1 for v in rows.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (6, 0), (99, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


def test_all_tied_terms_are_kept(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(1500)]
    bad, good = " ".join(words), " ".join(w[::-1] for w in words)
    rows = spark.createDataFrame([(i, i % 2, bad if i % 2 else good) for i in range(80)], "doc_id long, y int, text string")
    found = {t for t, _ in toxicity.chosen_terms(rows)}
    assert len(found) > 2000 and {f"={w}" for w in words} <= found


def test_all_as_near_as_the_last_vote():
    index = toxicity.Index([(i, int(i < 90), [0], [1]) for i in range(150)] + [(200, 1, [0, 1], [1, 1])], np.array([1.0, 2.0]), neighbours=15)
    at, near = index.nearest([0], [1], ties=True)
    assert len(at) == 150 and near == pytest.approx(np.ones(150)) and index.vote(at, near) == pytest.approx(0.6)
    at, _ = index.nearest([0], [1], skip=int(at[0]), ties=True)
    assert len(at) == 149
    assert len(index.nearest([0], [1])[0]) == 15
    few, near = index.nearest([1], [1], ties=True)
    assert len(few) == 1
