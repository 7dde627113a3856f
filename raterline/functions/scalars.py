"""Scalar expressions for ratings, labels and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sigmoid(z: Column) -> Column:
    """log(1 / (1 + exp(-z))) without overflow on either side."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def clipped(c: Column, low: float, high: float) -> Column:
    """Between low and high; null stays null, though greatest and least skip nulls."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ordinal(label: Column, scores: dict[str, float]) -> Column:
    """F1: a label's score, null if unknown."""
    out = F.lit(None).cast("double")
    for name, value in scores.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def mean_of(values: Column) -> Column:
    """mean of an array's non-null numbers, null if there are none."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some))


def age_midpoint(c: Column) -> Column:
    """'25-34' -> 29.5, '65+' -> 65."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)")), lambda v: v.cast("double"))
    return mean_of(numbers)


def word_list(text: Column) -> Column:
    """lower-case words of ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]+)"))


def lexicon_share(text: Column, lexicon: list[str]) -> Column:
    """the share of a text's words that a lexicon holds; 0 without words."""
    found = word_list(text)
    hit = F.filter(found, lambda w: w.isin(lexicon))
    return F.when(F.size(found) > 0, F.size(hit) / F.size(found)).otherwise(0.0)


def md5_prefix(*parts: Column) -> Column:
    """a short key."""
    return F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 12)


def leading_ordinal(c: Column, prefix: str) -> Column:
    """F8: the number after a prefix at the start, 0 if there is none."""
    return F.coalesce(F.regexp_extract(c, f"^{prefix}(\\d+)", 1).try_cast("long"), F.lit(0))


def span_days(first: Column, last: Column) -> Column:
    """whole days between two timestamps, rounded down."""
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / F.lit(86_400_000_000))
