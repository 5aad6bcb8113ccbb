"""Value counts and grouped aggregates over a stream: the batch operators' results, kept up as rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.groupings import aggregate
from gneiss.operators.predicates import column


def windowed_counts(stream: DataFrame, time: str, field: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts per value and time window; state of a window goes once the watermark has passed it."""
    rows = stream.where(column(field).isNotNull()).withWatermark(time, lateness)
    return rows.groupBy(F.window(column(time), window).alias("w"), column(field).alias("value")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "count")


def windowed_aggregate(stream: DataFrame, time: str, group: str, field: str, fn: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    rows = stream.na.drop("any", subset=[group, field]).withWatermark(time, lateness)
    out = rows.groupBy(F.window(column(time), window).alias("w"), column(group).alias("value")).agg(aggregate(fn, column(field)).alias("agg"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "agg")
