import random

import numpy as np
import pytest

from memstrata.llm import decontaminate as d

from .helpers import FOLDER, awkward, documents, empty


def plain_tiles(text, item, width):
    """Greedy tiling by looking at all pairs of places again and again."""
    marked_t, marked_i, tiles = [False] * len(text), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and not marked_t[t + n] and not marked_i[i + n]:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (t, i, n)
        if best is None:
            return tiles
        t, i, n = best
        tiles.append(best)
        marked_t[t:t + n] = [True] * n
        marked_i[i:i + n] = [True] * n


@pytest.mark.parametrize("seed", range(40))
def test_tiling_against_all_pairs(seed):
    r = random.Random(seed)
    words = "a b c d e f".split()[: 2 + seed % 5]
    text, item = [r.choice(words) for _ in range(r.randint(0, 60))], [r.choice(words) for _ in range(r.randint(5, 30))]
    items = d.Items([(7, " ".join(item))], width=3)
    want = plain_tiles(text, item, 3)
    got = items.matches(" ".join(text), 1e-9)
    assert (got[0][1] if got else []) == want


def test_reordered_passages_are_caught(spark):
    words = [f"w{i}" for i in range(40)]
    moved = words[30:] + ["x"] + words[10:20] + ["y"] + words[:10] + ["z"] + words[20:30]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(words[:15])), (3, " ".join(reversed(words))), (4, "Lead. " + ", ".join(w.upper() for w in words))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (10, "too short to match"), (11, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, len(r.tiles)) for r in d.find_contaminated(docs, bench).collect()}
    assert got == {(1, 9): (1.0, 4), (4, 9): (1.0, 1)}
    kept = d.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = sorted(map(tuple, d.find_contaminated(docs, bench).select("doc_id", "item_id", "coverage").collect()))
    real = d.item_blocks
    monkeypatch.setattr(d, "item_blocks", lambda b, i, t: real(b, i, t, 100))
    assert sorted(map(tuple, d.find_contaminated(docs, bench).select("doc_id", "item_id", "coverage").collect())) == whole
    assert whole


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_finds_items_that_stand_in_texts(spark, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    exact = {(r.doc_id, b.item_id) for r in documents(spark, folder).collect() for b in bench if b.text in r.text}
    got = {(r.doc_id, r.item_id) for r in d.op3(spark, folder).collect()}
    assert exact <= got
    for doc_id, item_id in got - exact:                       # any other must share half of the item in runs of five words
        text = next(r.text for r in documents(spark, folder).collect() if r.doc_id == doc_id)
        item = next(b.text for b in bench if b.item_id == item_id)
        n = len(d.tokens_of(item))
        assert sum(x for *_, x in plain_tiles(d.tokens_of(text), d.tokens_of(item), 5)) >= 0.5 * n


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(None, docs.first().text), (2, None), (3, "")], "item_id long, text string")
    rows = d.find_contaminated(docs, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 1), (False, 2), (False, 2), (False, 2), (False, 10), (True, None)]
    assert {r.item_id for r in rows} == {None}
    assert d.drop_contaminated(docs, bench).count() == 9 and d.drop_contaminated(docs, bench).columns == docs.columns
    none = bench.limit(0)
    assert d.find_contaminated(docs, none).count() == 0 and d.drop_contaminated(docs, none).count() == 15
    assert d.find_contaminated(empty(spark), bench).count() == 0 and d.drop_contaminated(empty(spark), bench).count() == 0


def test_rolling_hash_depends_on_order():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([5, 4, 3, 2, 1])
    assert d.rolling(a, 5)[0] != d.rolling(b, 5)[0] and len(d.rolling(a, 6)) == 0


def test_items_shorter_than_a_seed(spark):
    rows = [(1, "he said: Born in May 1911, then left"), (2, "born in"), (3, "Paris!"), (4, "may in born 1911"), (5, "1911 " + "x " * 300 + "paris paris"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "born in May 1911"), (2, "Paris"), (3, "said born in"), (4, "Born in"), (5, "?!"), (6, "one two three four five six")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, [t.length for t in r.tiles]) for r in d.find_contaminated(docs, bench).collect()}
    assert got == {(1, 1): (1.0, [4]), (1, 3): (1.0, [3]), (1, 4): (1.0, [2]), (2, 4): (1.0, [2]), (3, 2): (1.0, [1]), (5, 2): (1.0, [1])}
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [4, 6]
