"""Column helpers. All of them stay inside JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import USD

TERM_PATTERN = r"[\p{L}\p{N}_]+"
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


# ---- text -----------------------------------------------------------------

def query_terms(text: Column, limit: int = 64) -> Column:
    """Letter/number/underscore runs, case-exact distinct, first ``limit``."""
    runs = F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0))
    return F.slice(F.array_distinct(runs), 1, limit)


@lru_cache(maxsize=1)
def diacritic_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from decompositions."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii() and base.isalpha() and letter.lower() == letter:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    source, target = diacritic_map()
    return F.regexp_replace(F.translate(F.lower(text), source, target), r"[̀-ͯ]", "")


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def utf16_length(text: Column) -> Column:
    """UTF-16 code units; supplementary characters count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("int")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def preview(text: Column, n: int = 240) -> Column:
    return F.substring(text, 1, n)


# ---- identities -------------------------------------------------------------

def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def content_id(raw: Column) -> Column:
    return F.concat(F.lit("src_"), content_hash(raw))


def relative_path(digest: Column, at: Column) -> Column:
    return F.concat(F.lit("sources/"), F.date_format(at, "yyyy/MM/dd"), F.lit("/src_"), digest, F.lit(".md"))


def source_origin_key(source_id: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("source"), source_id, index.cast("string"))


def run_origin_key(run_id: Column, work_key: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("run"), run_id.cast("string"), work_key, index.cast("string"))


def work_identity(run_id: Column, work_key: Column) -> Column:
    return F.concat_ws("/", run_id.cast("string"), work_key)


CARRY_PATTERN = r"^carry:(\d+):([\s\S]+)$"


def carry_run(key: Column) -> Column:
    return F.when(key.rlike(CARRY_PATTERN), F.regexp_extract(key, CARRY_PATTERN, 1).cast("long"))


def carry_original_key(key: Column) -> Column:
    return F.when(key.rlike(CARRY_PATTERN), F.regexp_extract(key, CARRY_PATTERN, 2))


def carry_malformed(key: Column) -> Column:
    return key.startswith("carry:") & ~key.rlike(CARRY_PATTERN)


def canonical_id_set(ids: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(ids)))


def set_equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


# ---- time -------------------------------------------------------------------

def local_date(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def local_day_start(day: Column, zone: str) -> Column:
    """First valid instant of a local day; a midnight gap moves forward."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def dataset_timestamp(text: Column) -> Column:
    """``yyyy/MM/dd (ddd) HH:mm`` in UTC; anything else, a missing or wrong weekday too, is an error."""
    form = r"^(\d{4}/\d{2}/\d{2}) \(([A-Z][a-z]{2})\) (\d{2}:\d{2})$"
    at = F.try_to_timestamp(F.regexp_replace(text, form, "$1 $3"), F.lit("yyyy/MM/dd HH:mm"))
    fine = text.rlike(form) & at.isNotNull() & (F.date_format(at, "E") == F.regexp_extract(text, form, 2))
    bad = F.raise_error(F.concat(F.lit("not a dataset time: "), text)).cast("timestamp")
    return F.when(text.isNull(), F.lit(None).cast("timestamp")).when(fine, at).otherwise(bad)


def iso_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def in_period(at: Column, start: Column, end: Column) -> Column:
    return (at >= start) & (at < end)


# ---- numbers ----------------------------------------------------------------

def usd(value: Column) -> Column:
    return value.cast(USD)


def usd_add(a: Column, b: Column) -> Column:
    """a + b without losing the last digit.

    The sum of two decimal(38,12) would be rounded to a smaller scale, because
    its full precision does not fit; amounts of up to 25 integer digits do.
    """
    return (a.cast("decimal(37,12)") + b.cast("decimal(37,12)")).cast(USD)


def usd_sub(a: Column, b: Column) -> Column:
    return usd_add(a, -b.cast("decimal(37,12)"))


def rate(numerator: Column, denominator: Column) -> Column:
    """Null when the denominator is zero."""
    return F.try_divide(numerator.cast("decimal(20,6)"), denominator.cast("decimal(20,0)"))


def percentage_points(ratio: Column) -> Column:
    return ratio * F.lit(100)


def root_threshold(base: int, depth: Column) -> Column:
    """base ** depth, exact up to 10 ** 30; above that a number that no count of roots reaches."""
    return F.aggregate(
        F.transform(F.sequence(F.lit(0), depth.cast("int")), lambda i: i),
        F.lit(1).cast("decimal(38,0)"),
        lambda acc, i: F.when(i == 0, acc).otherwise((F.least(acc, F.lit("1" + "0" * 30).cast("decimal(38,0)")) * F.lit(base)).cast("decimal(38,0)")),
    )


def token_cost(input_tokens: Column, cached: Column, writes: Column, output: Column, price) -> Column:
    """Exact cost of one request; ``price(name)`` yields a price column."""
    long = F.coalesce(input_tokens > price("long_threshold"), F.lit(False))
    one = F.lit(1).cast("decimal(9,3)")
    m = F.when(long, price("long_input_factor")).otherwise(one)
    n = F.when(long, price("long_output_factor")).otherwise(one)
    d = lambda c: c.cast("decimal(12,0)")
    spent_in = (d(input_tokens - cached - writes) * price("input_price")
                + d(cached) * price("cached_price")
                + d(writes) * price("write_price"))
    total = (spent_in.cast("decimal(26,6)") * m + (d(output) * price("output_price")).cast("decimal(26,6)") * n)
    return F.when(input_tokens >= cached + writes,
                  (total.cast("decimal(28,9)") / F.lit(1000000)).cast(USD))


def max_reservation(payload_bytes: Column, max_output: Column, price) -> Column:
    """Upper bound of a request's cost; the input bound adds 8192 to the payload."""
    bound = payload_bytes + F.lit(8192)
    long = F.coalesce(bound > price("long_threshold"), F.lit(False))
    one = F.lit(1).cast("decimal(9,3)")
    m = F.when(long, price("long_input_factor")).otherwise(one)
    n = F.when(long, price("long_output_factor")).otherwise(one)
    worst = F.greatest(price("input_price"), price("cached_price"), price("write_price"))
    total = ((bound.cast("decimal(12,0)") * worst).cast("decimal(26,6)") * m
             + (max_output.cast("decimal(12,0)") * price("output_price")).cast("decimal(26,6)") * n)
    return (total.cast("decimal(28,9)") / F.lit(1000000)).cast(USD)


# ---- json -------------------------------------------------------------------

def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("long")


def json_bool(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("boolean")


def json_shallow_merge(old: Column, new: Column) -> Column:
    """Top-level keys of ``new`` replace those of ``old``; values stay opaque."""
    as_map = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,string>")
    a, b = as_map(old), as_map(new)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(kept), F.map_entries(b))))


# ---- vectors ----------------------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v)


def norm_squared(a: Column) -> Column:
    return _dot(a, a)


def vector_is_valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Double accumulation over float inputs; invalid pairs raise."""
    ok = vector_is_valid(a) & vector_is_valid(b) & (F.size(a) == F.size(b))
    value = _dot(a, b) / F.sqrt(norm_squared(a) * norm_squared(b))
    return F.when(ok, value).otherwise(F.raise_error(F.lit("vectors are not comparable")).cast("double"))


# ---- evaluation ---------------------------------------------------------------

def abstention_flag(question_id: Column) -> Column:
    return question_id.contains("_abs")


def judge_score(response: Column) -> Column:
    return F.lower(response).contains("yes")


def judge_prompt_route(question_type: Column, question_id: Column, known: list[str]) -> Column:
    """Template name: abstention overrides the type, an unknown type is an error."""
    return (F.when(abstention_flag(question_id), F.lit("abstention"))
            .when(question_type.isin(known), question_type)
            .otherwise(F.raise_error(F.concat(F.lit("unknown question type: "), question_type)).cast("string")))
