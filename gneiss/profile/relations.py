"""Hierarchies inside a table, and join candidates between tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column

HIERARCHY = 0.5
SIMILAR = 0.8
SAMPLES, LOST = 96, 1e-9


def hierarchy_pairs(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(parent, child, ratio, is_edge): distinct children over the sum of distinct children per parent.

    One scan, and one distinct for all pairs of fields: both directions of a pair are counted on its distinct
    pairs of values, those with a null or NaN left out. A table without rows has none.
    """
    schema = "parent string, child string, ratio double, is_edge boolean"
    if len(fields) < 2:
        return df.sparkSession.createDataFrame([], schema)
    some = {f: ~F.isnan(column(f)) if isinstance(df.schema[f].dataType, T.FractionalType) and not isinstance(df.schema[f].dataType, T.DecimalType) else F.lit(True) for f in fields}
    text = {f: F.when(some[f], column(f).cast("string")) for f in fields}
    both = list(combinations(fields, 2))
    of_row = []
    for n, (a, b) in enumerate(both):
        whole = text[a].isNotNull() & text[b].isNotNull()
        of_row.append(F.struct(F.lit(n).alias("pair"), F.when(whole, text[a]).alias("a"), F.when(whole, text[b]).alias("b")))
    pairs = df.select(F.explode(F.array(*of_row)).alias("x")).select("x.*").distinct()
    per = pairs.groupBy("pair").agg(F.count("a").alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"))
    first, second = (F.array(*[F.lit(p[i]) for p in both])[F.col("pair")] for i in (0, 1))
    edge = lambda parent, child, count: F.struct(parent.alias("parent"), child.alias("child"), F.when(F.col("n") > 0, F.col(count) / F.col("n")).alias("ratio"))
    out = per.select(F.explode(F.array(edge(first, second, "nb"), edge(second, first, "na"))).alias("x")).select("x.*")
    return out.withColumn("is_edge", F.coalesce(F.col("ratio") >= HIERARCHY, F.lit(False)))


def hierarchies(df: DataFrame, fields: Sequence[str]) -> dict[str, dict[str, list[str]]]:
    """Children, parents and one-to-ones of each field."""
    edges = {(r["parent"], r["child"]) for r in hierarchy_pairs(df, fields).where("is_edge").collect()} if len(fields) > 1 else set()
    return {
        f: {
            "one_to_ones": [g for g in fields if (f, g) in edges and (g, f) in edges],
            "children": [g for g in fields if (f, g) in edges and (g, f) not in edges],
            "parents": [g for g in fields if (g, f) in edges and (f, g) not in edges],
        }
        for f in fields
    }


def least_matches(samples: int = SAMPLES, similar: float = SIMILAR, lost: float = LOST) -> int:
    """Equal MinHash samples that two sets of this similarity fall short of with a chance of `lost` at most (a binomial tail)."""
    below, p = 0.0, [math.comb(samples, k) * similar**k * (1 - similar) ** (samples - k) for k in range(samples + 1)]
    for k in range(samples + 1):
        below += p[k]
        if below > lost:
            return k
    return samples


def field_sketches(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, samples): the least of SAMPLES hashes over each field's values, in one pass that ships a row a field and task."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.xxhash64(column(f).cast("string")).alias("h"), column(f).isNotNull().alias("some")) for f in fields])).alias("x")
    rows = df.select(each).select("x.*").where("some")
    least = rows.groupBy("field").agg(*[F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(SAMPLES)])
    return least.select("field", F.array(*[f"m{i}" for i in range(SAMPLES)]).alias("samples"))


def likely_pairs(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], least: float = SIMILAR) -> list[tuple[str, str, str, str]]:
    """(ds, field, ds, field) of different tables whose sketches agree often enough for a similarity of `least`."""
    sketches = [(name, r["field"], r["samples"]) for name, (df, fields) in tables.items() if fields for r in field_sketches(df, fields).collect()]  # a row a field
    need = least_matches(similar=least)
    return [(a, f, b, g) for (a, f, x), (b, g, y) in combinations(sorted(sketches), 2) if a != b and sum(p == q for p, q in zip(x, y, strict=True)) >= need]


def discover_joins(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], least: float = SIMILAR) -> DataFrame:
    """Field pairs of different tables whose distinct values have a Jaccard similarity of `least` or more.

    MinHash sketches of the fields settle which pairs may reach it; a pair that does is missed with a chance under
    LOST. Only the values of those pairs are compared, exactly: each value goes to the pairs of its field, and a
    value that both fields of a pair hold counts for it, in one grouping without a join.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    pairs = likely_pairs(tables, least)
    schema = "source string, source_field string, target string, target_field string, similarity double, type string"
    if not pairs:
        return spark.createDataFrame([], schema)
    values = None
    for name, field in dict.fromkeys(e for a, f, b, g in pairs for e in ((a, f), (b, g))):
        of = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(2 if (b, g) == (name, field) else 1).alias("side")) for i, (a, f, b, g) in enumerate(pairs) if (name, field) in ((a, f), (b, g))])
        df = tables[name][0]
        one = df.where(column(field).isNotNull()).select(column(field).cast("string").alias("v")).distinct().select("v", F.explode(of).alias("x")).select("x.*", "v")
        values = one if values is None else values.unionAll(one)
    held = values.groupBy("pair", "v").agg(F.bit_or("side").alias("sides"))
    sizes = held.groupBy("pair").agg(F.count_if(F.col("sides").bitwiseAND(1) > 0).alias("size"), F.count_if(F.col("sides").bitwiseAND(2) > 0).alias("size_b"), F.count_if(F.col("sides") == 3).alias("both"))
    similarity = F.col("both") / (F.col("size") + F.col("size_b") - F.col("both"))
    kind = F.when(F.col("size") == F.col("size_b"), "11").when(F.col("size") > F.col("size_b"), "N1").otherwise("1N")
    names = [F.array(*[F.lit(p[i]) for p in pairs])[F.col("pair")].alias(n) for i, n in enumerate(("source", "source_field", "target", "target_field"))]
    return sizes.select(*names, similarity.alias("similarity"), kind.alias("type")).where(F.col("similarity") >= least)
