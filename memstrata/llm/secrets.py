"""Secret scans by corpus-wide ownership frequency.

Every text is scanned for candidates. The hash of each candidate's value is
counted over the corpus by distinct repositories and owners: a value that
many owners have is a copied example, one that a single owner has and that
looks random is reported as live. The patterns of the base kinds are always
reported; random-looking tokens outside them are added where one owner alone
has them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memstrata.session import durable

from .common import slices, table

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Beyond the base kinds: runs of token characters, of any length, that have a letter and a digit anywhere. Possessive, so linear.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
MIN_ASSIGN, MIN_ACCESS, MIN_BITS = 6, 20, 3.0
EXAMPLE_OWNERS = 4       # so many owners make a value a copied example

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()),
                     T.StructField("value_hash", T.StringType()), T.StructField("bits", T.DoubleType())])


def bits(value: str) -> float:
    """Entropy of the characters of a value, in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, by start and then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: s[:3])


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Opaque tokens that no base span touches."""
    out = []
    for m in OPAQUE.finditer(text):
        if DIGIT.search(m[0]) and LETTER.search(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, owner, repository, base_sha256 and found (array of candidates)."""
    repository = repository or doc_id
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
                         F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"),
                         F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*picked.schema.fields[:4], T.StructField("base_sha256", T.StringType()),
                           T.StructField("found", T.ArrayType(SPAN))])

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
                    spans = base + added_spans(body, base)
                    found.append([{"start": s, "kind": k, "end": e, "bits": bits(v),
                                   "value_hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for s, k, e, v in spans])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.string()), pa.array(found, arrow.field("found").type)], schema=arrow)

    return picked.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories) of candidates; a repository counts once per owner.

    Three counts from the inside out, each with partial sums before its
    shuffle, so a value that a third of all documents hold is never one task's
    rows.
    """
    once = found.select("value_hash", "owner", "repository").distinct()
    by_owner = once.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def find_secrets(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, **options) -> DataFrame:
    """row, doc_id, owner, base_sha256 and spans: array of (start, kind, end, owners, repositories, verdict), by start and kind.

    ``verdict`` is ``example`` (``example_owners`` owners or more have the
    value), ``live`` (one owner has it, and it has ``MIN_BITS`` bits per
    character), else ``unclear``. Base kinds are kept whatever the verdict,
    opaque tokens only when live. Null and empty texts have no spans; a null
    owner or repository counts as one of its own; repeated rows give repeated
    results and count once; an empty table gives an empty result; further
    columns of ``docs`` are not read. Whole texts are scanned, and offsets are
    code points.
    """
    rows = durable(scan(docs, **options))
    found = rows.select("row", "owner", "repository", F.inline("found"))
    shared = ownership(found).where("owners > 1 or repositories > 1")
    judged = (found.join(shared, "value_hash", "left")
              .withColumns({"owners": F.coalesce("owners", F.lit(1)), "repositories": F.coalesce("repositories", F.lit(1))})
              .withColumn("verdict", F.when(F.col("owners") >= example_owners, "example")
                          .when((F.col("owners") == 1) & (F.col("bits") >= MIN_BITS), "live").otherwise("unclear"))
              .where((F.col("kind") < 3) | (F.col("verdict") == "live")))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "verdict"))).alias("spans"))
    return rows.select("row", "doc_id", "owner", "base_sha256").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    # a second parameter of a test would be the position in the array
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    verdicts = F.array_join(F.transform("spans", lambda s: s["verdict"]), ",")
    return found.select("doc_id", *[count("kind", k).alias(f"n_{KINDS[k]}") for k in range(3)], "base_sha256",
                        text.alias("spans"), verdicts.alias("verdicts"),
                        count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_example"))
