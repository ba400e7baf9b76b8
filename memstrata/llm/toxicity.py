"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over word and word-beginning terms that the labelled
examples tie to the label; document frequencies are counted over the whole
corpus. The nearest examples by exact cosine come from an inverted index that
keeps the largest weight of each block of postings: blocks are visited by
their bound, until no other can reach the k-th similarity. The votes of the
neighbours (all that are as near as the k-th), weighted by distance, are calibrated on the examples themselves,
each left out in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memstrata.session import durable

from .common import slices, table

MAX_EXAMPLES = 20_000     # labelled rows that the model is fitted on, the first by a hash of their id
MIN_SUPPORT = 4           # examples that a term needs
MIN_CHI = 20.0            # chi-square of term and label
NEIGHBOURS = 15
BLOCK = 64
BEGINNINGS = (4, 5, 6)
REPEATS = (1, 2, 3)       # a term found twice or three times is a further term: by chance it seldom is
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 300_000


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *[f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]]


def tally(text: str | None, terms=terms_of) -> Counter:
    """How often each term of a text occurs."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for t in terms(word):
            found[t] += n
    return found


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) != 1


def examples(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label_id: str, label: str, limit: int) -> DataFrame:
    """(doc_id, y, text) of at most ``limit`` labelled rows, in the order of a hash of the id.

    Rows without id or label are no examples; of several labels of an id the
    greatest holds, of several texts the first by hash.
    """
    own = (labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & learnable(F.col("id")))
           .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit))
    chosen = F.broadcast(durable(own))         # at most ``limit`` pairs of numbers
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    one = texts.join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "y", "text")
    return one.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def chosen_terms(rows: DataFrame) -> list[tuple[str, int]]:
    """(term, how often at least) that are tied to the label, by their chi-square among the examples."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for y, body in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                (toxic if y else clean).update((t, k) for t, n in tally(body).items() for k in REPEATS if n >= k)
        terms = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in terms], pa.string()), pa.array([k for _, k in terms], pa.int32()),
                                          *[pa.array([side[t] for t in terms], pa.int64()) for side in (toxic, clean)]], names=["term", "least", "a", "b"])

    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return []
    counted = rows.mapInArrow(count, "term string, least int, a long, b long").groupBy("term", "least").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), n1 + n0
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b + 0.5) * n1 * n0)
    best = (counted.where((F.col("a") + F.col("b") >= MIN_SUPPORT) & (F.col("a") * n0 > F.col("b") * n1 * 4)).withColumn("chi", chi)
            .where(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "term", "least"))
    return [(r["term"], r["least"]) for r in best.select("term", "least").collect()]


def vectors(docs: DataFrame, terms: list[tuple[str, int]], text: str, doc_id: str) -> DataFrame:
    """doc_id, terms (numbers, ascending) and counts of each row of ``docs``; whole texts are read."""
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([picked.schema["doc_id"], T.StructField("terms", kind), T.StructField("counts", kind)])
    bases = {t: n for n, t in enumerate(dict.fromkeys(t for t, _ in terms))}
    steps: list[list[tuple[int, int]]] = [[] for _ in bases]
    for i, (t, least) in enumerate(terms):
        steps[bases[t]].append((least, i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        known: dict[str, tuple[int, ...]] = {}

        def known_terms(word: str) -> tuple[int, ...]:
            hits = known.get(word)
            if hits is None:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                hits = known[word] = tuple(bases[t] for t in terms_of(word) if t in bases)
            return hits

        for whole in batches:
            for batch in slices(whole, "text"):
                which, counts = [], []
                for body in batch.column("text").to_pylist():
                    found = sorted((i, n) for base, n in tally(body, known_terms).items() for least, i in steps[base] if n >= least)
                    which.append([i for i, _ in found])
                    counts.append([n for _, n in found])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(which, arrow.field(1).type), pa.array(counts, arrow.field(2).type)], schema=arrow)

    return picked.mapInArrow(run, schema)


class Index:
    """Unit vectors of the examples, inverted, with the largest weight of each term in each block of examples."""

    def __init__(self, rows: list[tuple[object, int, list[int], list[int]]], idf: np.ndarray, neighbours: int = NEIGHBOURS) -> None:
        rows = sorted(rows, key=lambda r: (tuple(r[2]), tuple(r[3]), str(r[0])))      # like vectors stand in one block
        self.ids, self.idf, self.k = [r[0] for r in rows], idf, neighbours
        self.y = np.array([r[1] for r in rows], float)
        blocks = -(-len(rows) // BLOCK)
        self.largest = np.zeros((len(idf), blocks), np.float64)
        at, term, weight = [], [], []
        for i, (_, _, terms, counts) in enumerate(rows):
            w = self.weights(terms, counts)
            at.append(np.full(len(terms), i))
            term.append(np.array(terms, int))
            weight.append(w)
            np.maximum.at(self.largest, (np.array(terms, int), i // BLOCK), w)
        at, term, weight = (np.concatenate(x) if x else np.zeros(0) for x in (at, term, weight))
        order = np.lexsort((at, term))
        self.at, self.weight = at[order].astype(int), weight[order].astype(float)
        self.starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.visited = 0

    def weights(self, terms: list[int], counts: list[int]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, float))) * self.idf[np.array(terms, int)]
        size = np.sqrt((w * w).sum())
        return w / size if size else w

    def nearest(self, terms: list[int], counts: list[int], skip: int = -1, ties: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a positive cosine; equal ones by their place. ``ties``: and of all as near as the k-th."""
        q = self.weights(terms, counts)
        bounds = q @ self.largest[terms]
        order = np.argsort(-bounds, kind="stable")
        got_at, got = np.zeros(0, int), np.zeros(0)
        step, start = 4, 0
        while start < len(order):
            visit = order[start:start + step]
            if bounds[visit[0]] <= 0 or (len(got) >= self.k and bounds[visit[0]] < got[self.k - 1] - 1e-12):
                break
            self.visited += len(visit)
            first = np.sort(visit) * BLOCK
            scores = np.zeros((len(visit), BLOCK))
            for t, w in zip(terms, q):
                lo, hi = self.starts[t], self.starts[t + 1]
                a = np.searchsorted(self.at[lo:hi], first)
                b = np.searchsorted(self.at[lo:hi], first + BLOCK)
                for row in np.flatnonzero(b > a):
                    part = slice(lo + a[row], lo + b[row])
                    scores[row, self.at[part] - first[row]] += w * self.weight[part]
            place = (first[:, None] + np.arange(BLOCK)[None, :]).ravel()
            flat = scores.ravel()
            live = (flat > 0) & (place != skip)
            got_at, got = np.r_[got_at, place[live]], np.r_[got, flat[live]]
            best = np.lexsort((got_at, -got))
            upto = np.searchsorted(-got[best], 1e-13 - got[best[self.k - 1]], "right") if ties and len(best) > self.k else self.k
            got_at, got = got_at[best[:upto]], got[best[:upto]]
            start, step = start + step, step * 2
        return got_at, np.minimum(got, 1.0)

    def vote(self, at: np.ndarray, near: np.ndarray) -> float:
        """Share of toxic neighbours, each weighted by its closeness."""
        w = near / (1.02 - near)
        return float((w * self.y[at]).sum() / w.sum()) if len(at) else 0.0


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: (upper ends, means) of steps, each with one case of doubt added."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for v, t in zip(x[order], y[order]):
        if pools and pools[-1][0] == v:
            pools[-1][1] += t
            pools[-1][2] += 1
        else:
            pools.append([float(v), float(t), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] and pools[-1][0] != v:
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    merged: list[list[float]] = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
            last = merged.pop()
            merged[-1] = [last[0], merged[-1][1] + last[1], merged[-1][2] + last[2]]
    return np.array([p[0] for p in merged]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in merged])


class Scorer:
    """Index, calibration, and the score of texts without any term."""

    def __init__(self, index: Index | None, rows: list, base: float) -> None:
        self.index, self.base, self.known = index, base, {}
        if index is None:
            return
        by_id = {i: n for n, i in enumerate(index.ids)}
        votes = []
        for doc_id, _, terms, counts in rows:
            at, near = index.nearest(terms, counts, skip=by_id[doc_id], ties=True)
            votes.append(index.vote(at, near))
        self.ends, self.means = rising(np.array(votes), np.array([r[1] for r in rows], float))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[int], list[float]]:
        if self.index is None or not terms:
            return self.base, [], []
        key = (tuple(terms), tuple(counts))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            at, near = self.index.nearest(terms, counts, ties=True)
            vote = self.index.vote(at, near)
            step = min(int(np.searchsorted(self.ends, vote, "left")), len(self.means) - 1)
            self.known[key] = (float(self.means[step]) if len(at) else self.base, at[:3].tolist(), near[:3].tolist())
        return self.known[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label_id: str = "doc_id", label: str = "toxic",
                   limit: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score (0 to 1) and evidence (array of example, similarity) of every row of ``docs``.

    The score reads the text alone; equal texts have equal scores. A text
    without any term, a null or empty one too, gets the share of toxic
    examples among those without a term. Without examples of both labels all
    scores are that of the labels' share, 0.5 if there are none. Ids may be
    null or repeated; an empty table gives an empty result; further columns
    are not read. The fitted part is bounded by ``limit`` examples; document
    frequencies are counted over all of ``docs``.
    """
    spark = docs.sparkSession
    own = durable(examples(docs, labels, text, doc_id, label_id, label, limit))
    terms = chosen_terms(own)
    rows = durable(vectors(docs, terms, text, doc_id))
    total = rows.count()
    counted = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()   # terms of at most ``limit`` examples
    idf = np.full(len(terms), np.log(1 + total))
    for r in counted:
        idf[r["t"]] = np.log(1 + total / r["df"])
    mine = [(r["doc_id"], r["y"], list(r["terms"]), list(r["counts"]))
            for r in vectors(own.select("doc_id", "text"), terms, "text", "doc_id").join(own.select("doc_id", "y"), "doc_id").collect()]   # at most ``limit``
    mine.sort(key=lambda r: str(r[0]))
    without = [r[1] for r in mine if not r[2]]
    base = (sum(without) + 0.5) / (len(without) + 1)
    those = [r for r in mine if r[2]]
    index = Index(those, idf, neighbours) if those else None
    sent = spark.sparkContext.broadcast(Scorer(index, those, base))
    id_type = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema["doc_id"]
    label_type = labels.schema[label_id].dataType
    schema = T.StructType([id_type, T.StructField("score", T.DoubleType()),
                           T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("example", label_type), T.StructField("similarity", T.DoubleType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        scorer = sent.value
        for batch in batches:
            scores, evidence = [], []
            for which, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                score, at, near = scorer.score(which, counts)
                scores.append(score)
                evidence.append([{"example": scorer.index.ids[i], "similarity": s} for i, s in zip(at, near)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, arrow.field(2).type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
                         F.transform("evidence", lambda e: e["example"]).alias("evidence"))
