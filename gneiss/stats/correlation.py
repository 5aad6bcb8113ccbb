"""Pearson's matrix with p-values from one aggregation, nulls left out pair by pair."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.predicates import column, filtered
from gneiss.stats import dist


def correlation_pairs(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(a, b, n, r) for each pair of fields."""
    stats, rows = [], []
    for i, (a, b) in enumerate(combinations(fields, 2)):
        x, y = column(a).cast("double"), column(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        stats += [F.count_if(both).alias(f"n{i}"), F.corr(F.when(both, x), F.when(both, y)).alias(f"r{i}")]
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")))
    return df.agg(*stats).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def pearson_p(r: float | None, n: int) -> float | None:
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else dist.t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def correlate(df: DataFrame, fields: Sequence[str], conditionals: Mapping | None = None) -> list[list[list[float | None]]]:
    """The upper triangle of [r, p]; [1, 0] on the diagonal, [None, None] below."""
    got = {(x["a"], x["b"]): [x["r"], pearson_p(x["r"], x["n"])] for x in correlation_pairs(filtered(df, conditionals), fields).collect()} if len(fields) > 1 else {}
    return [[[1.0, 0.0] if i == j else got[a, b] if i < j else [None, None] for j, b in enumerate(fields)] for i, a in enumerate(fields)]


def correlation_scatter(df: DataFrame, fields: Sequence[str], n: int = 100, seed: int = 0) -> DataFrame:
    """At most n points of each pair."""
    out = None
    for a, b in combinations(fields, 2):
        rows = df.na.drop("any", subset=[a, b]).orderBy(F.rand(seed)).limit(n).select(F.lit(a).alias("a"), F.lit(b).alias("b"), column(a).cast("double").alias("x"), column(b).cast("double").alias("y"))
        out = rows if out is None else out.union(rows)
    return out
