"""Scalar parsing as built-in expressions: amounts, number words, labels, dates, names, identity numbers.

Bad input gives null, never an error, also in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docsleuth.functions import fixed


def parse_amount(v: Column) -> Column:
    """All but digits and minus signs deleted, then a whole number or null."""
    return F.regexp_replace(v, "[^0-9-]", "").try_cast("bigint")


def blank_to_null(v: Column) -> Column:
    return F.nullif(v, F.lit(""))


def first_filled(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def normalize_label(v: Column) -> Column:
    """X03."""
    return F.trim(F.regexp_replace(F.lower(F.trim(v)), "[^a-z0-9]+", "_"), F.lit("_"))


def slug(v: Column) -> Column:
    """X34."""
    return F.trim(F.regexp_replace(v, "[^A-Za-z0-9_-]", "_"), F.lit("_"))


def number_words(v: Column) -> Column:
    """English number words as a number; null if a word is unknown or there is none."""
    value = F.create_map(*[F.lit(x) for kv in fixed.NUMBER_WORDS.items() for x in kv])
    scale = F.create_map(*[F.lit(x) for kv in fixed.NUMBER_SCALES.items() for x in kv])
    words = F.filter(F.regexp_extract_all(F.lower(v), F.lit("[a-z]+"), F.lit(0)), lambda w: w != "and")
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("now"), F.lit(True).alias("ok"))

    def step(a: Column, w: Column) -> Column:
        unit, by = value[w], scale[w].cast("bigint")
        now = F.when(unit.isNotNull(), a["now"] + unit).when(by == 100, F.greatest(a["now"], F.lit(1).cast("bigint")) * 100).when(by.isNotNull(), F.lit(0).cast("bigint")).otherwise(a["now"])
        total = F.when(by > 100, a["total"] + F.greatest(a["now"], F.lit(1).cast("bigint")) * by).otherwise(a["total"])
        return F.struct(total.alias("total"), now.alias("now"), (a["ok"] & (unit.isNotNull() | by.isNotNull())).alias("ok"))

    return F.when(F.size(words) > 0, F.aggregate(words, start, step, lambda a: F.when(a["ok"], a["total"] + a["now"])))


def _dates(v: Column, *formats: str) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(v, F.lit(f))) for f in formats])


def bank_date(v: Column) -> Column:
    """X24, for ledger rows."""
    return _dates(v, "d-M-yyyy", "d-MMM-yyyy", "d/M/yyyy")


def statement_date(v: Column) -> Column:
    return _dates(v, "d-M-yyyy", "d-MMM-yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy")


def employment_date(v: Column) -> Column:
    return _dates(v, "d MMMM yyyy", "d-M-yyyy", "d/M/yyyy", "yyyy-M-d", "d MMM yyyy")


def pay_period(period: Column, pay_date: Column) -> Column:
    return F.coalesce(_dates(period, "MMMM yyyy"), _dates(pay_date, "M/d/yyyy", "M/d/yy"))


def pan_valid(v: Column) -> Column:
    """X29."""
    return F.upper(F.trim(v)).rlike(fixed.PAN)


def pan_entity(v: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in fixed.PAN_ENTITIES.items() for x in kv])
    return F.when(pan_valid(v), F.coalesce(kinds[F.substring(F.upper(F.trim(v)), 4, 1)], F.lit("Unknown")))


def pan_surname_initial(v: Column) -> Column:
    return F.when(pan_valid(v), F.substring(F.upper(F.trim(v)), 5, 1))


def name_parts(v: Column) -> Column:
    """First and last run of letters, in capitals."""
    parts = F.regexp_extract_all(F.upper(F.coalesce(v, F.lit(""))), F.lit("[A-Z]+"), F.lit(0))
    return F.struct(F.get(parts, 0).alias("first"), F.try_element_at(parts, F.lit(-1)).alias("last"))


def dob(v: Column) -> Column:
    """Canonical dd/mm/yyyy and year; a year alone has no canonical form."""
    raw = F.trim(F.coalesce(v, F.lit("")))
    p = F.filter(F.split(raw, "[^0-9]"), lambda x: x != "")
    part = lambda i, n: F.lpad(F.get(p, i), n, "0")
    full = F.when(F.size(p) == 3, F.when(F.length(F.get(p, 0)) == 4, F.concat_ws("/", part(2, 2), part(1, 2), part(0, 4))).when(F.length(F.get(p, 2)) == 4, F.concat_ws("/", part(0, 2), part(1, 2), part(2, 4))))
    year = F.coalesce(F.substring(full, 7, 4), F.when((F.size(p) == 1) & (F.length(F.get(p, 0)) == 4), F.get(p, 0)))
    return F.struct(raw.alias("raw"), full.alias("full"), year.alias("year"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def display_similarity(s: Column) -> Column:
    """A cosine as a percentage for people."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (s + 0.5) / 1.5 * 100)), 1)


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if there are none."""
    words = lambda v: F.array_distinct(F.filter(F.split(F.lower(F.trim(v)), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def text_quality(v: Column) -> Column:
    """X25."""
    t = F.coalesce(v, F.lit(""))
    hit = lambda pattern, w: F.when(t.rlike(pattern), F.lit(w)).otherwise(0.0)
    return F.round(hit(r"\S", 0.2) + hit(r"[A-Za-z]{3,}", 0.2) + hit(r"\d{3,}", 0.1) + hit(r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.3) + hit(r"\b\d{4}\s?\d{4}\s?\d{4}\b", 0.2), 2)


def image_only(v: Column, pages: Column) -> Column:
    """X26."""
    return F.length(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s", "")) < F.greatest(F.lit(20), pages * 20)


def prettify(v: Column) -> Column:
    """X38."""
    return F.initcap(F.replace(F.replace(v, F.lit("::"), F.lit(" › ")), F.lit("_"), F.lit(" ")))


def register(spark: SparkSession) -> None:
    """SQL functions for users, with SQL bodies, so that Catalyst inlines them."""
    bodies = {
        "parse_amount(v STRING) RETURNS BIGINT": "try_cast(nullif(regexp_replace(v, '[^0-9-]', ''), '') AS BIGINT)",
        "normalize_label(v STRING) RETURNS STRING": "trim(BOTH '_' FROM regexp_replace(lower(trim(v)), '[^a-z0-9]+', '_'))",
        "pan_valid(v STRING) RETURNS BOOLEAN": f"upper(trim(v)) RLIKE '{fixed.PAN}'",
        "cosine_display(s DOUBLE) RETURNS DOUBLE": "round(greatest(0D, least(100D, (s + 0.5D) / 1.5D * 100D)), 1)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
