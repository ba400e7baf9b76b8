"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans. Expectation
maximisation over the counted vote patterns of the whole corpus estimates how
reliable each labeler is, and a logistic span classifier is trained on the
resulting soft labels. Base spans are always reported; other candidates are
added where the classifier accepts them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memstrata.session import durable

from .common import slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail_words", "local_phone", "national_id", "iban", "long_number")
LABELERS = ("form", "check", "gazetteer", "context")

AT = re.compile("@")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms: spelled-out addresses, local phones, national numbers, account numbers.
LOOSE = (
    (4, re.compile(r"\b[A-Za-z0-9._-]{2,64}\x20?[\[(]?\bat\b[\])]?\x20?[A-Za-z0-9-]{2,63}\x20?[\[(]?\bdot\b[\])]?\x20?(?:com|org|net|edu|io)\b")),
    (5, re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")),
    (6, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (7, re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b")),
)
#: Common top-level domains, calling codes, words that stand before personal data and before other numbers.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "81", "82", "86", "90", "91")
COUNTRIES = frozenset("DE FR ES IT NL BE AT CH GB IE PT PL".split())
BEFORE = re.compile(r"\b(?:e-?mail|contact|phone|tel|call|fax|mobile|card|visa|account|ssn|iban|ip|host|address|reach|write)\b", re.I)
AGAINST = re.compile(r"\b(?:version|isbn|order|invoice|page|section|figure|id|commit|build|release)\b", re.I)
CONTEXT = 40

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("votes", T.StringType()), T.StructField("shape", T.StringType())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part runs back to the first other character."""
    out, last = [], 0
    for m in AT.finditer(text):
        at = m.start()
        if at < last:
            continue
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        if left < at and (right := DOMAIN.match(text, at + 1)):
            out.append((left, last := right.end()))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append((2, m.start(), m.end()))
    out += cards
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser forms that touch no base span and no earlier candidate."""
    out: list[tuple[int, int, int]] = []
    for kind, pattern in LOOSE:
        if kind == 4 and "dot" not in text:
            continue
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for _, s, e in [*taken, *out]):
                out.append((kind, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and not any(s < m.end() and m.start() < e for _, s, e in [*taken, *out]):
            if 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                out.append((8, m.start(), m.end()))
    return out


def vote(text: str, kind: int, start: int, end: int) -> tuple[str, str]:
    """The labelers' votes on a span (+, - or . for none), and its shape: length class and neighbours."""
    value = text[start:end]
    digits = "".join(c for c in value if c.isdigit())
    form = "+" if kind < 8 else "."
    check = "."
    if kind in (2, 8):
        check = "+" if 13 <= len(digits) <= 19 and luhn(digits) else "-"
    elif kind == 1:
        check = "-" if value.startswith(("0.", "127.", "255.")) else "+"
    elif kind in (3, 5):
        check = "-" if len(set(digits)) < 3 else "+"
    elif kind == 6:
        check = "-" if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else "+"
    elif kind == 7:
        plain = value.replace(" ", "")
        moved = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        check = "+" if int(moved) % 97 == 1 else "-"
    known = "."
    if kind in (0, 4):
        known = "+" if re.split(r"[.\x20]", value.lower())[-1] in DOMAINS else "-"
    elif kind == 3:
        known = "+" if digits.startswith(CALLING) else "-"
    elif kind == 7:
        known = "+" if value[:2] in COUNTRIES else "-"
    around = text[max(0, start - CONTEXT):start]
    context = "+" if BEFORE.search(around) else "-" if AGAINST.search(around) else "."
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end:end + 1].isalnum())
    return form + check + known + context, f"{min(3, (end - start) // 8)}{int(glued)}"


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: row, doc_id, base_sha256 and found (array of candidates with votes)."""
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*picked.schema.fields[:2], T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for batch in slices(whole, "text"):
                digests, found = [], []
                for body in batch.column("text").to_pylist():
                    body = body or ""
                    base = base_spans(body)
                    digests.append(hashlib.sha256(named(base).encode()).hexdigest())
                    rows = []
                    for k, s, e in base + loose_spans(body, base):
                        votes, shape = vote(body, k, s, e)
                        rows.append({"kind": k, "start": s, "end": e, "votes": votes, "shape": shape})
                    found.append(rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.string()), pa.array(found, arrow.field("found").type)], schema=arrow)

    return picked.mapInArrow(run, schema)


def reliabilities(patterns: list[tuple[str, float]], rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation maximisation over (votes, count).

    Gives the share of personal spans, per labeler and class the probabilities
    of the votes (+, -, .), and each pattern's posterior. Labelers are taken
    to be independent given the class; the start prefers the majority vote.
    """
    codes = np.array([["+-.".index(v) for v in p] for p, _ in patterns], dtype=int).reshape(len(patterns), len(LABELERS))
    weight = np.array([n for _, n in patterns], dtype=float)
    plus, minus = (codes == 0).sum(1), (codes == 1).sum(1)
    post = np.clip(0.5 + 0.2 * plus - 0.3 * minus, 0.05, 0.95)
    share, table_ = 0.5, np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(rounds):
        share = float(np.clip((weight * post).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        for c, p in ((1, post), (0, 1 - post)):
            for j in range(len(LABELERS)):
                n = np.array([(weight * p * (codes[:, j] == v)).sum() for v in range(3)]) + 1.0
                table_[c, j] = n / n.sum()
        one, zero = np.log(share), np.log(1 - share)
        for j in range(len(LABELERS)):
            one, zero = one + np.log(table_[1, j, codes[:, j]]), zero + np.log(table_[0, j, codes[:, j]])
        post = 1 / (1 + np.exp(np.clip(zero - one, -50, 50)))
    return share, table_, post


def span_features(kind: int, votes: str, shape: str) -> np.ndarray:
    x = [1.0, *[float(kind == k) for k in range(len(KINDS))]]
    for v in votes:
        x += [float(v == "+"), float(v == "-")]
    return np.array([*x, *[float(shape[0] == str(k)) for k in range(4)], float(shape[1] == "1")])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(hessian, gradient)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def span_model(found: DataFrame) -> DataFrame | None:
    """(kind, votes, shape, p) from the candidates of the whole corpus; None without candidates.

    Spark counts the patterns; what reaches the driver is at most 9 kinds x 81
    votes x 8 shapes, whatever the corpus.
    """
    counts = [(r["kind"], r["votes"], r["shape"], float(r["n"])) for r in found.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).orderBy("kind", "votes", "shape").collect()]
    if not counts:
        return None
    _, _, post = reliabilities([(v, n) for _, v, _, n in counts])
    x = np.array([span_features(k, v, s) for k, v, s, _ in counts])
    w = train(x, post, np.array([n for *_, n in counts]))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return found.sparkSession.createDataFrame([(k, v, s, float(q)) for (k, v, s, _), q in zip(counts, p)], "kind int, votes string, shape string, p double")


def find_private(docs: DataFrame, accept: float = 0.5, **options) -> DataFrame:
    """row, doc_id, base_sha256 and spans: array of (kind, start, end, p), by kind and start.

    Base spans are kept whatever ``p``; the others need ``accept``. Null and
    empty texts have no spans; ids may be null or repeated, every row is
    judged; an empty table gives an empty result; further columns of ``docs``
    are not read. Whole texts are scanned, and offsets are code points.
    """
    rows = durable(scan(docs, **options))
    found = rows.select("row", F.inline("found"))
    model = span_model(found)
    kind = "array<struct<kind:int,start:int,end:int,p:double>>"
    if model is None:
        return rows.select("row", "doc_id", "base_sha256", F.array().cast(kind).alias("spans"))
    judged = found.join(F.broadcast(model), ["kind", "votes", "shape"]).where((F.col("kind") < len(BASE)) | (F.col("p") >= accept))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "p"))).alias("spans"))
    return rows.select("row", "doc_id", "base_sha256").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = find_private(table(spark, folder, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{BASE[k]}") for k in range(4)], "base_sha256", text.alias("spans"),
                        F.size(F.filter("spans", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_added"))
