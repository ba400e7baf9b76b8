import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memstrata.llm import quality

from .helpers import FOLDER, awkward, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = {}, set()
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    r = random.Random(3)
    made = ["".join(r.choice("ab c\n\t#|é😀\x0b") for _ in range(r.randint(0, 120))) for _ in range(300)]
    made += ["a " * 50, "x y z w v u " * 4, "a b c d e a b c d e", "\n\n a\n a\nb", "", None, "a b c\x1cd"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").unionByName(documents(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    for x in quality.text_counts(docs).collect():
        assert (x["__n_words"], x["__word_chars"], x["__n_symbols"], x["__n_dup_lines"], x["__n_repeat_words"]) == counts(x["text"]), x["text"]


def fitted(rows: np.ndarray):
    """The estimate of one group in NumPy."""
    floors = np.array(list(quality.FLOORS.values())) * quality.UNIT
    mean, l = np.sort(rows, axis=0)[(len(rows) - 1) // 2], np.diag(floors)

    def steps(mean, l):
        z = np.linalg.solve(l, (rows - mean).T)
        return np.floor(np.minimum((z * z).sum(0), 1e6) * quality.GRID)

    for turn in range(quality.STEPS + 1):
        step = steps(mean, l)
        bound = np.sort(step)[int(np.ceil(quality.SHARE * len(rows))) - 1]
        if turn == quality.STEPS:
            return mean, l * np.sqrt(max(1.0, (bound + 1) / (quality.GRID * quality.CHI_SHARE)))
        kept = rows[step <= bound]
        mean = kept.mean(0)
        l = np.linalg.cholesky(np.cov(kept.T, bias=True) + np.diag(floors ** 2))


def verdicts(rows):
    """(doc id) -> kept, in Python: rows are (doc_id, text, lang, source)."""
    names = list(quality.FLOORS)
    stats, base = {}, {}
    for i, t, _, _ in rows:
        n, chars, symbols, dup, rep = counts(t)
        base[i] = n < 10 or 100 * rep > 20 * n
        stats[i] = [int(np.floor(v * quality.UNIT + 0.5)) for v in (np.log((chars + 250) / (n + 50)), np.log1p(100 * symbols / (n + 50)), np.log1p(100 * dup / (n + 50)), np.log1p(20 * rep / (n + 50)))]
    assert len(names) == 4
    members = {}
    for i, _, lang, source in rows:
        if not base[i]:
            for g in ((lang, source), (lang,), ()):
                members.setdefault(g, []).append(stats[i])
    fits = {g: fitted(np.array(m, float)) for g, m in members.items() if len(m) >= quality.MIN_GROUP}
    out = {}
    for i, _, lang, source in rows:
        own = next((fits[g] for g in ((lang, source), (lang,), ()) if g in fits), None)
        far = 0.0
        if own is not None:
            z = np.linalg.solve(own[1], np.array(stats[i]) - own[0])
            far = float((z * z).sum())
        out[i] = (not base[i] and far <= quality.CUTOFF, far)
    return out


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_against_numpy(spark, folder):
    want = verdicts([(r.doc_id, r.text, r.lang, r.source) for r in documents(spark, folder).collect()])
    for r in quality.op9(spark, folder).collect():
        kept, far = want[r.doc_id]
        assert r.distance == pytest.approx(far, rel=1e-6, abs=1e-6)
        assert r.kept == kept


def test_junk_goes_and_good_text_stays(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.op9(spark, folder).join(labels, "doc_id").groupBy("quality", "kept", "base_failed").count().collect()
    n = {(r.quality, r.kept, r.base_failed): r["count"] for r in rows}
    assert n.get((1, False, False), 0) == 0 and n.get((0, True, False), 0) == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["__n_words"] == counts(r["text"])[0] and r["__base_failed"] == (r["__n_words"] < 10 or 100 * r["__n_repeat_words"] > 20 * r["__n_words"])
        assert r["__kept"] == (not r["__base_failed"])           # too few rows for any estimate
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_null_groups_are_fitted(spark):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(60))
    rows = [(i, text(), None, None) for i in range(100)] + [(100, " | ".join(f"a{i}b" for i in range(60)), None, None)]
    got = {x["doc_id"]: x["__kept"] for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(100)) and not got[100]


def test_main_path_has_no_python(spark):
    plan = quality.op9(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names_stay(spark):
    own = ["__n_words", "__kept", "__distance", "__base_failed", "__n_repeat_words", "__words", "__e", "__g0", "__length", "given"]
    docs = documents(spark).select("*", *[F.lit("x").alias(c) for c in own])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r[c] for r in rows for c in own} == {"x"}
    assert {r.doc_id for r in rows} == {r.doc_id for r in quality.keep_good(documents(spark)).collect()}


def test_bound_of_counted_steps(spark):
    r = random.Random(5)
    steps = {g: [int(10 ** r.uniform(0, 7)) for _ in range(n)] for g, n in (("a", 1), ("b", 4), ("c", 997))}
    rows = [(g, s, v.count(s)) for g, v in steps.items() for s in set(v)]
    got = {x.g: x.bound for x in quality._bound(spark.createDataFrame(rows, "g string, step long, count long")).collect()}
    assert got == {g: sorted(v)[int(np.ceil(quality.SHARE * len(v))) - 1] for g, v in steps.items()}
