"""Scalar expressions that specs and statistics use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(c: Column) -> Column:
    """Letters, digits and underscores only; no leading digit."""
    x = F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_")
    return F.when(x.rlike(r"^\d"), F.concat(F.lit("_"), x)).otherwise(x)


def parse_number(c: Column) -> Column:
    """A double from text with thousands separators, or null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def log_shifted(x: Column, least_nonzero: Column) -> Column:
    return F.log(x + 0.01 * least_nonzero)


def band(mean: Column, error: Column) -> Column:
    return F.format_string("%.3f ± %.3f", mean, error)


def interval(left: Column, right: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f-%.{places}f", left, right)


def shannon(counts: Column) -> Column:
    """Entropy, base e, of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return -F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x / total * F.log(x / total))
