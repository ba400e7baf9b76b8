"""Quality rules: counts of a text and robust multivariate outliers.

Per language and source, a minimum-covariance-determinant estimate of the
mean and covariance of transformed text statistics is found by concentration
steps: the share of rows nearest to the current estimate gives the next one.
Texts whose squared Mahalanobis distance is beyond the cutoff are rejected.
DataFrame functions only; the fits are sums by group, never gathered rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memstrata.session import broadcast_measured, durable

from .common import SPACES, fresh, stored_texts, table, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

SHARE = 0.75          # of a group's rows that the concentration steps keep
STEPS = 3             # concentration steps
MIN_GROUP = 60        # smaller groups use their language's estimate, then the one of all rows
CUTOFF = 42.0         # squared distance; a chi-square of 4 dimensions is above it once in 60 million
CHI_SHARE = 5.385     # the SHARE quantile of a chi-square of 4 dimensions
#: The statistics in order, and the least spread that each is given: an estimate cannot become narrower.
FLOORS = {"length": 0.08, "symbols": 0.35, "lines": 0.30, "repeats": 0.30}
UNIT = 1000           # statistics are kept as whole thousandths, so that sums do not depend on their order
GRID = 64             # distances are ranked in steps of a 64th
COARSE = 4096         # steps in a bin of the counted distances


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words (long).

    Whole texts are read. A null text counts as an empty one. A word is a run
    without ASCII white space; a repeated word lies in a 5-word window that is
    found twice or more. Windows are compared as 64-bit hashes first; only
    texts with an equal pair are counted again, on the words themselves.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    step = (docs.withColumn("__words", words_of(body)).withColumn("__lines", lines)
            .withColumn("__n_symbols", F.coalesce(F.regexp_count(body, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"))
            .withColumn("__word_chars", F.length(F.array_join("__words", "")).cast("long"))
            .withColumn("__n_words", F.size("__words").cast("long"))
            .withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
            .drop("__lines"))
    last = F.size("__words") - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)]))
    step = step.withColumn("__hashes", hashes)
    step = step.withColumn("__twice", F.size(F.array_distinct("__hashes")) < F.size("__hashes")).drop("__hashes")
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice("__words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    step = step.withColumn("__windows", F.when(F.col("__twice"), windows))
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    found = F.filter("__windows", lambda x, j: same(x, F.get("__windows", j + 1)) | same(x, F.get("__windows", j - 1)))
    step = step.withColumn("__at", F.array_sort(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", j + 1) - p, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__words", "__twice", "__windows", "__at")


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))


def statistics() -> dict[str, Column]:
    """The transformed statistics in whole thousandths. Pseudo-counts draw short texts to ordinary values."""
    n = F.col("__n_words").cast("double")
    raw = {
        "length": F.log((F.col("__word_chars") + 250) / (n + 50)),
        "symbols": F.log1p(100 * F.col("__n_symbols") / (n + 50)),
        "lines": F.log1p(100 * F.col("__n_dup_lines") / (n + 50)),
        "repeats": F.log1p(20 * F.col("__n_repeat_words") / (n + 50)),
    }
    return {k: F.round(v * UNIT).cast("long") for k, v in raw.items()}


NAMES = list(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _moments(rows: DataFrame) -> DataFrame:
    """Per group: mean and lower covariance, with the floors added to the diagonal, as a lower Cholesky factor.

    The sums are exact whole numbers, so neither the order of rows nor their
    partitions change the estimate.
    """
    sums = rows.groupBy("g").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)],
        *[F.sum((F.col(NAMES[i]) * F.col(NAMES[j])).cast("decimal(28,0)")).alias(f"q{i}{j}") for i, j in PAIRS])
    mean = [(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(len(NAMES))]
    cov = []
    for i, j in PAIRS:
        c = F.col(f"q{i}{j}").cast("double") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))
        cov.append(c.alias(f"c{i}{j}"))
    return sums.select("g", "n", *mean, *cov)


def _factor(cov: DataFrame, scale: Column) -> DataFrame:
    """Cholesky factor l of scale x covariance + floors, one written column after the other."""
    out = cov.withColumn("scale", scale)
    for i, j in PAIRS:
        value = F.col(f"c{i}{j}") * F.col("scale")
        if i == j:
            value = value + (FLOORS[NAMES[i]] * UNIT) ** 2
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l{j}{j}"))
    return durable(out.select("g", *[f"m{i}" for i in range(len(NAMES))], *[f"l{i}{j}" for i, j in PAIRS]))


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(NAMES):
        value = F.col(f"{prefix}{x}") - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * z[k]
        z.append(value / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _bound(counted: DataFrame) -> DataFrame:
    """(g, bound): the least step up to which a group has its share, from (g, step, count)."""
    bins = counted.groupBy("g", F.floor(F.col("step") / COARSE).alias("bin")).agg(F.sum("count").alias("inside"))
    run = Window.partitionBy("g").orderBy("bin")
    bins = bins.withColumns({"upto": F.sum("inside").over(run), "all": F.sum("inside").over(Window.partitionBy("g"))})
    held = (bins.where((F.col("upto") >= SHARE * F.col("all")) & (F.col("upto") - F.col("inside") < SHARE * F.col("all")))
            .select(F.col("g").alias("of"), F.col("bin").alias("of_bin"), (F.col("upto") - F.col("inside")).alias("before"), "all"))
    steps = counted.join(held, (F.col("g") == F.col("of")) & (F.floor(F.col("step") / COARSE) == F.col("of_bin")))
    steps = steps.withColumn("upto", F.col("before") + F.sum("count").over(Window.partitionBy("g").orderBy("step")))
    return steps.where(F.col("upto") >= SHARE * F.col("all")).groupBy("g").agg(F.min("step").alias("bound"))


def fit(rows: DataFrame) -> DataFrame:
    """MCD estimates of the rows (g and the statistics): one row per group.

    Concentration starts from the rows nearest to the group's medians in units
    of the floors, and then repeats ``STEPS`` times: mean and covariance of
    the kept share, distances of all rows, the share of nearest rows. The
    bound of the share is read from counts by distance step in two levels:
    which coarse bin holds it, then which step of that bin, so a group with a
    third of all rows is never more than ``COARSE`` steps, or as many bins as
    the largest distance has, in one window.
    The last covariance is scaled so that the share's distance agrees with a
    chi-square's.
    """
    centre = rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(NAMES)])
    start = centre.select("g", *[f"m{i}" for i in range(len(NAMES))],
                          *[F.lit(FLOORS[NAMES[i]] * UNIT if i == j else 0.0).alias(f"l{i}{j}") for i, j in PAIRS])
    estimate = durable(start)
    for turn in range(STEPS + 1):
        far = rows.join(estimate, "g").select("g", *NAMES, F.floor(F.least(_distance(), F.lit(1e6)) * GRID).alias("step"))
        bound = durable(_bound(durable(far.groupBy("g", "step").count())))
        if turn == STEPS:
            scale = F.greatest((F.col("bound") + 1) / (GRID * CHI_SHARE), F.lit(1.0))
            scaled = estimate.join(bound, "g").withColumn("scale", F.sqrt(scale))
            return durable(scaled.select("g", *[f"m{i}" for i in range(len(NAMES))],
                                         *[(F.col(f"l{i}{j}") * F.col("scale")).alias(f"l{i}{j}") for i, j in PAIRS]))
        estimate = _factor(_moments(far.join(bound, "g").where("step <= bound")), F.lit(1.0))
    raise AssertionError


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with the counts of ``text_counts``, __base_failed and __kept.

    Estimates are fitted on the rows that pass the base rules. A group is a
    language and a source (nulls are values of their own); below ``MIN_GROUP``
    rows it is judged by its language's estimate, and where that has too few
    rows as well, by the one of all rows; a table with too few rows altogether
    is judged by the base rules alone. Null and empty texts have no words and
    fail the base rules. Ties and repeated rows are judged alike. An empty
    table gives an empty result. All columns of ``docs`` are kept as they are;
    the new ones get underscores in front while there is such a column.
    """
    # the given row is carried as one value, so that no name of its own meets a name of ours
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(f"`{text}`").alias("text"))
    counted = text_counts(given, "text").drop("text").withColumn("__base_failed", base_failed())
    place = F.to_json(F.struct(F.col(f"given.`{lang}`").alias("l"), F.col(f"given.`{source}`").alias("s")))
    wide = F.to_json(F.struct(F.col(f"given.`{lang}`").alias("w")))
    keys = [F.concat(F.lit("0"), place), F.concat(F.lit("1"), wide), F.lit("2")]
    marked = stored_texts(counted.withColumns({f"__{k}": v for k, v in statistics().items()} | {f"__g{i}": k for i, k in enumerate(keys)}))
    used = _estimate_used(marked)
    levels = sorted(r[0] for r in used.select(F.substring("g", 1, 1)).where("g is not null").distinct().collect())
    sound = marked.where("not __base_failed").select(F.explode(F.array(*[F.col(f"__g{i}") for i in levels])).alias("g") if levels else F.lit("").alias("g"),
                                                     *[F.col(f"__{x}").alias(x) for x in NAMES])
    estimates = fit(sound.join(used.select("g").distinct(), "g", "left_semi"))
    own = used.join(estimates.select("g", F.struct(*[c for c in estimates.columns if c != "g"]).alias("__e")), "g", "left").select(F.col("g0").alias("__of"), "__e")
    # one row per language and source: texts stay where they are as long as these are few
    far = marked.join(broadcast_measured(own), F.col("__g0") == F.col("__of")).drop("__of", *[f"__g{i}" for i in range(len(keys))])
    z: list[Column] = []
    for i, x in enumerate(NAMES):
        value = F.col(f"__{x}") - F.col(f"__e.m{i}")
        for k in range(i):
            value = value - F.col(f"__e.l{i}{k}") * F.col(f"__z{k}")
        far = far.withColumn(f"__z{i}", value / F.col(f"__e.l{i}{i}"))
        z.append(F.col(f"__z{i}") * F.col(f"__z{i}"))
    distance = z[0] + z[1] + z[2] + z[3]
    far = far.withColumn("__distance", distance)
    kept = ~F.col("__base_failed") & F.coalesce(F.col("__distance") <= CUTOFF, F.lit(True))
    own = ("__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed", "__distance", "__kept")
    return far.withColumn("__kept", kept).select(*[F.col(f"given.`{c}`") for c in docs.columns], *[F.col(c).alias(fresh(docs, c)) for c in own])


def _estimate_used(marked: DataFrame) -> DataFrame:
    """(g0, g): the estimate that judges each language and source: its own, its language's, the one of all, or none (null)."""
    groups = durable(marked.groupBy("__g0", "__g1", "__g2").agg(F.count_if(~F.col("__base_failed")).alias("n")))
    wide = groups.groupBy("__g1").agg(F.sum("n").alias("n1"))
    everything = groups.groupBy("__g2").agg(F.sum("n").alias("n2"))
    sized = groups.join(wide, "__g1").join(everything, "__g2")
    return durable(sized.select(F.col("__g0").alias("g0"), F.when(F.col("n") >= MIN_GROUP, F.col("__g0")).when(F.col("n1") >= MIN_GROUP, F.col("__g1"))
                                .when(F.col("n2") >= MIN_GROUP, F.col("__g2")).alias("g")))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    Nulls, empty texts, ties, repeated rows and clashing names are as in
    ``judge``; an empty table gives an empty result.
    """
    judged = judge(docs, **options)
    return judged.where(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return judge(docs).select("doc_id", *[F.col(f"__{c}").alias(c) for c in own])
