"""Bin counts, edges and histograms. One small aggregate goes to the driver; rows never do."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.groupings import MEDIAN, aggregate, medians
from gneiss.operators.predicates import column
from gneiss.operators.ranges import quantiles

MAX_BINS, DEFAULT_BINS, MAX_HISTOGRAM_BINS = 20, 10, 30


def as_number(df: DataFrame, field: str) -> Column:
    """The field as a double; a time as microseconds."""
    kind = df.schema[field].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(column(field).cast("timestamp")).cast("double")
    return column(field).cast("double")


@dataclass(frozen=True)
class BinStats:
    count: int
    low: float | None
    high: float | None
    q1: float | None
    q3: float | None
    skew: float | None
    distinct: int
    integral: bool


def bin_stats_frame(df: DataFrame, field: str) -> DataFrame:
    x = as_number(df, field)
    rows = df.select(x.alias("x"))
    one = rows.agg(
        F.count("x").alias("count"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.skewness("x").alias("skew"),
        F.coalesce(F.bool_and(F.col("x") == F.floor("x")), F.lit(True)).alias("integral"),
    )
    distinct = rows.where("x is not null").distinct().agg(F.count("*").alias("distinct"))
    ends = quantiles(rows, "x", (0.25, 0.75)).toDF("q1", "q3")
    return one.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(distinct)).select("count", "low", "high", "q1", "q3", "skew", "distinct", "integral")  # one row each


def bin_stats(df: DataFrame, field: str) -> BinStats:
    return BinStats(**bin_stats_frame(df, field).first().asDict())


def number_of_bins(s: BinStats, procedure: str = "freedman") -> int:
    """Bins by a named rule, 20 at most, 10 where the rule says none; a constant column has one."""
    if not s.count or s.low == s.high:
        return 1
    n = s.count
    if procedure == "freedman":
        width = 2 * (s.q3 - s.q1) * n ** (-1 / 3)
        k = (s.high - s.low) / width if width else math.inf
    elif procedure == "square_root":
        k = math.sqrt(n)
    elif procedure == "doane":
        sigma = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) if n > 2 else math.inf
        k = 1 + math.log2(n) + math.log2(1 + abs(s.skew or 0) / sigma)
    elif procedure == "rice":
        k = 2 * n ** (1 / 3)
    elif procedure == "sturges":
        k = math.ceil(math.log2(n) + 1)
    else:
        raise ValueError(f"unknown binning procedure {procedure!r}")
    return int(min(k, MAX_BINS)) or DEFAULT_BINS


def bin_edges(s: BinStats, bins: int, precision: int | None = None) -> list[float]:
    """bins + 1 edges, evenly spaced, rounded to precision + 1 places but never past the data."""
    if s.low is None:
        return []
    places = (1 if s.integral else 3) if precision is None else precision
    inner = [round(s.low + (s.high - s.low) * i / bins, places + 1) for i in range(1, bins)]
    return [s.low, *inner, s.high]


def even_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges at even distances, rounded to one place, the last one a tenth further so that the greatest value is inside."""
    edges = [round(low + (high - low) * i / bins, 1) for i in range(bins + 1)]
    return [*edges[:-1], edges[-1] + 0.1]


def bin_index(x: Column, edges: list[float], right_closed: bool = False) -> Column:
    """Bin of a number from 0, null outside: [l, r) with the last closed, or (l, r] with the first closed."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    above = [(x > e if right_closed else x >= e).cast("int") for e in edges[1:-1]]
    index = reduce(lambda a, b: a + b, above) if above else F.lit(0)
    return F.when((x >= edges[0]) & (x <= edges[-1]), index)


def bin_label(edges: list[float], i: int, precision: int = 3) -> str:
    return f"{edges[i]:.{precision}f}-{edges[i + 1]:.{precision}f}"


def histogram(df: DataFrame, field: str, agg_field: str | None = None, fn: str = "count", edges: list[float] | None = None, bins: int | None = None, procedure: str = "freedman") -> DataFrame:
    """An aggregate for each bin; empty bins count 0."""
    if edges is None:
        s = bin_stats(df, field)
        k = bins or number_of_bins(s, procedure)
        edges = bin_edges(s, min(k, MAX_HISTOGRAM_BINS, max(s.distinct, 1) if s.integral else k))
    x = as_number(df, field)
    rows = df.where(x.isNotNull()) if agg_field is None else df.na.drop("any", subset=[field, agg_field])
    binned = rows.select(bin_index(x, edges).alias("bin"), column(agg_field or field))
    if agg_field is not None and fn == MEDIAN:
        got = medians(binned, column(agg_field), {"bin": F.col("bin")}, "agg")
    else:
        got = binned.groupBy("bin").agg((F.count("*") if agg_field is None else aggregate(fn, column(agg_field))).alias("agg"))
    all_bins = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, left double, right double")
    return all_bins.join(got, "bin", "left").select("bin", "left", "right", F.coalesce("agg", F.lit(0)).alias("agg"))
