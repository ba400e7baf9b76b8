import random

import numpy as np
import pytest

from memstrata.llm import neardup
from memstrata.llm.common import components

from .helpers import FOLDER, awkward, documents, empty, groups, shingles


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    docs = documents(spark)
    want = groups([(r.doc_id, r.text) for r in docs.collect()], width, percent)
    got = neardup.near_groups(docs, width=width, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.first == (r.component_id == r.doc_id) for r in got)


def test_query(spark):
    rows = {r.doc_id: r for r in neardup.op5(spark, FOLDER).collect()}
    for d in documents(spark).collect():
        assert rows[d.doc_id].n_shingles == len(shingles(d.text, 3))
        assert rows[d.doc_id].kept == (rows[d.doc_id].component_id == d.doc_id)


def family(n: int, seed: int, changes: tuple[int, int]) -> list[str]:
    """Variants of one text with words exchanged, so that some are linked and some are not."""
    r = random.Random(seed)
    base = [f"b{seed}w{i}" for i in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for i in r.sample(range(120), r.randint(*changes)):
            w[i] = f"v{seed}c{k}i{i}"
        out.append(" ".join(w))
    return out


def chain(n: int, seed: int) -> list[str]:
    """Each text is near the next, the ends are not near each other."""
    words = [f"c{seed}w{i}" for i in range(100 + 4 * n)]
    return [" ".join(words[4 * k:4 * k + 100]) for k in range(n)]


def test_families_and_chains(spark):
    texts = family(60, 1, (0, 8)) + family(40, 2, (2, 6)) + chain(30, 3) + chain(12, 4)
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts))
    want = groups(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.near_groups(docs, width=3, percent=85).collect()}
    assert got == want


@pytest.mark.parametrize(("limit", "block"), [(4096, 7), (3, 512), (3, 5)])
def test_remaining_lists_in_blocks(spark, limit, block, monkeypatch):
    """Whole families, and list by list beyond the limit, in one block and in several."""
    from memstrata.llm import neardup as module
    real = module.remaining_links
    monkeypatch.setattr(module, "remaining_links", lambda a, b, c, d: real(a, b, c, d, limit, block))
    rows = list(enumerate(family(50, 7, (0, 9)) + chain(20, 8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_groups(docs, width=3, percent=85).collect()}
    assert got == groups(rows, 3, 85)


def test_awkward_rows(spark):
    rows = neardup.near_groups(awkward(spark)).collect()
    assert len(rows) == 15
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[2]} == {1} and by[1][0].first and not any(r.first for r in by[2])
    assert by[3][0].component_id == 3 and by[4][0].component_id == 4 and by[5][0].n_shingles == 0
    assert by[8][0].component_id == 7 and by[10][0].component_id == 1
    assert sorted((r.component_id is None, r.n_shingles == 0) for r in by[None]) == [(False, False), (True, True)]
    docs = awkward(spark)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sum(r.first for r in rows) == kept.count()
    assert neardup.near_groups(empty(spark)).count() == 0 and neardup.drop_near_duplicates(empty(spark)).count() == 0


def test_threshold_and_signatures():
    assert neardup.threshold(85) == 39 and neardup.threshold(80) == 34
    r = np.random.default_rng(1)
    counts = []
    for _ in range(400):
        both, a, b = (r.integers(0, 1 << 63, n, np.uint64) for n in (170, 15, 15))
        counts.append(int((neardup.signature(np.r_[both, a]) == neardup.signature(np.r_[both, b])).sum()))
    assert abs(np.mean(counts) - 64 * 0.85) < 0.5 and min(counts) >= 39 and np.std(counts) < 3.3


def test_shared_counts():
    sets = [np.unique(np.random.default_rng(i).integers(0, 400, 90)).astype(np.uint64) for i in range(12)] + [np.zeros(0, np.uint64)]
    got = neardup.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(300)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = top(a), top(b)
            parent[max(p, q)] = min(p, q)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
