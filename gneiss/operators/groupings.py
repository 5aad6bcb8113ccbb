"""The group-by family behind charts. Every operator gives long form; formatting is apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.predicates import column
from gneiss.operators.ranges import counted, quantiles, with_sums_before

CHART_LIMIT = 100


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


AGGREGATES = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": F.stddev_samp,
    "sem": standard_error,
    "count": F.count,
}
MEDIAN = "median"
COPIES = 1_000_000  # equal rows that one array lists


def aggregate(fn: str, x: Column) -> Column:
    """G1: an aggregate by name; std and sem are sample statistics, count leaves nulls out. Medians need medians()."""
    return AGGREGATES[fn](x)


def medians(df: DataFrame, x: Column, by: dict[str, Column], name: str) -> DataFrame:
    """(by, name): exact medians from counted values, so that no group's rows are held in one buffer."""
    rows = df.select(*[c.alias(f"g{i}") for i, c in enumerate(by.values())], x.alias("x"))
    return quantiles(rows, "x", (0.5,), [f"g{i}" for i in range(len(by))]).toDF(*by, name)


def scalar_aggregates(df: DataFrame, field: str) -> DataFrame:
    """One row; std is over the population here and count includes nulls."""
    x = column(field)
    one = df.agg(F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count("*").alias("count"))
    half = quantiles(df.select(x.alias("x")), "x", (0.5,)).toDF(MEDIAN)
    return one.crossJoin(F.broadcast(half)).select("sum", "min", "max", "mean", MEDIAN, "std", "count")  # one row each


def single(df: DataFrame, field: str, fn: str) -> DataFrame:
    """One value; mode takes the smallest of equally frequent ones, from counted values."""
    x = column(field)
    if fn == MEDIAN:
        return quantiles(df.select(x.alias("x")), "x", (0.5,)).toDF("value")
    if fn == "mode":
        per = counted(df.select(x.alias("x")), "x")
        return per.agg(F.min(F.struct((-F.col("__n")).alias("n"), "x"))["x"].alias("value"))
    return df.where(x.isNotNull()).agg(aggregate(fn, x).alias("value"))


def value_counts(df: DataFrame, field: str, limit: int | None = CHART_LIMIT) -> DataFrame:
    """Values by falling frequency, then by value; limit None gives all."""
    counts = df.where(column(field).isNotNull()).groupBy(column(field).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return counts if limit is None else counts.limit(limit)


def value_aggregate(df: DataFrame, group: str, field: str, fn: str) -> DataFrame:
    """One aggregate per group, a mean with its standard error band."""
    x = column(field)
    whole = df.na.drop("any", subset=[group, field])
    if fn == MEDIAN:
        return medians(whole, x, {"value": column(group)}, "agg")
    rows = whole.groupBy(column(group).alias("value"))
    if fn != "mean":
        return rows.agg(aggregate(fn, x).alias("agg"))
    mean, sem = F.avg(x), standard_error(x)
    return rows.agg(mean.alias("agg"), (mean - sem).alias("lower"), (mean + sem).alias("upper"))


def aggregate_pairs(df: DataFrame, group: str, a: str, b: str, fn: str) -> DataFrame:
    """The same aggregate of two fields per group, over rows with both."""
    rows = df.na.drop("any", subset=[group, a, b])
    if fn == MEDIAN:
        by = {"value": column(group)}
        return medians(rows, column(a), by, "agg_a").join(medians(rows, column(b), by, "agg_b"), "value")
    return rows.groupBy(column(group).alias("value")).agg(aggregate(fn, column(a)).alias("agg_a"), aggregate(fn, column(b)).alias("agg_b"))


def multigroup(df: DataFrame, a: str, b: str, field: str | None = None, fn: str = "count") -> DataFrame:
    """Counts, or an aggregate of field, per pair of groups."""
    whole = df.na.drop("any", subset=[x for x in (a, b, field) if x])
    rows = whole.groupBy(column(a).alias("a"), column(b).alias("b"))
    if field is None:
        return rows.agg(F.count("*").alias("count"))
    x = column(field)
    if fn == MEDIAN:
        return medians(whole, x, {"a": column(a), "b": column(b)}, "agg")
    if fn != "mean":
        return rows.agg(aggregate(fn, x).alias("agg"))
    mean, sem = F.avg(x), standard_error(x)
    return rows.agg(mean.alias("agg"), (mean - sem).alias("lower"), (mean + sem).alias("upper"), F.format_string("%.3f ± %.3f", mean, sem).alias("cell"))


def pivoted(long: DataFrame, value: str, limit: int = 1000) -> DataFrame:
    """Wide form of multigroup: a row per a, a column per b in order; a missing pair is null."""
    header = [r[0] for r in long.select("b").distinct().orderBy("b").limit(limit + 1).collect()]
    if len(header) > limit:
        raise ValueError(f"over {limit} columns; use the long form")
    return long.groupBy("a").pivot("b", header).agg(F.first(value))


def box(df: DataFrame, group: str, field: str) -> DataFrame:
    """Quartiles, mean and whiskers, the farthest values within 1.5 interquartile ranges; all from counted values."""
    samples = df.na.drop("any", subset=[group, field]).select(column(group).alias("value"), column(field).alias("x"))
    x = F.col("x").cast("double")
    q = quantiles(samples, "x", (0.25, 0.5, 0.75), ["value"], {"mean": F.sum(x * F.col("__n")) / F.sum("__n")}).toDF("value", "q1", "median", "q3", "mean")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = counted(samples, "x", ["value"]).join(q, "value").where((F.col("x") <= F.col("q3") + reach) & (F.col("x") >= F.col("q1") - reach))
    ends = fenced.groupBy("value", "q1", "median", "mean", "q3").agg(F.min("x").alias("bottom"), F.max("x").alias("top"))
    return ends.select("value", "bottom", "q1", "median", "mean", "q3", "top")


def value_pairs(df: DataFrame, a: str, b: str, subset: int | None = 200, seed: int = 0) -> DataFrame:
    """Rows of two fields, all or a seeded draw of `subset`."""
    rows = df.na.drop("any", subset=[a, b]).select(column(a).alias("a"), column(b).alias("b"))
    return rows if subset is None else rows.orderBy(F.rand(seed)).limit(subset)


def indexed_values(df: DataFrame, field: str, order: Sequence[str]) -> DataFrame:
    """Position and value in an explicit order, counted range by range.

    Rows with the same keys stand in the order of their values' hash. Equal rows are counted first and dealt out
    again behind their first position, so neither a hot key nor a hot row meets in one task.
    """
    keys = [f"o{i}" for i in range(len(order))]
    rows = df.select(column(field).alias("value"), *[column(c).alias(k) for k, c in zip(keys, order, strict=True)]).groupBy("value", *keys).agg(F.count("*").alias("copies"))
    first = with_sums_before(rows, keys, {"before": F.col("copies")}).select("before", "copies", "value")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("piece")
    first = first.select("before", "copies", "value", F.when(F.col("copies") > COPIES, F.col("before")).alias("hot"))
    few, many = first.where("hot is null"), first.where("hot is not null").select("*", piece)
    many = many.select((F.col("before") + F.col("piece") * COPIES).alias("before"), F.least(F.col("copies") - F.col("piece") * COPIES, F.lit(COPIES).cast("long")).alias("copies"), "value").repartition("before")
    out = few.select("before", "copies", "value").unionByName(many)
    return out.select(F.explode(F.sequence("before", F.col("before") + F.col("copies") - 1)).alias("index"), "value")


def edges(df: DataFrame, a: str, b: str, field: str) -> DataFrame:
    """A weighted edge list."""
    return df.na.drop("any", subset=[a, b]).groupBy(column(a).alias("source"), column(b).alias("target")).agg(F.sum(column(field)).alias("weight"), F.count("*").alias("count"))


def fused(df: DataFrame, group: str, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Every (field, aggregate) of one group in a single pass; columns are named fn(field). Each median takes one of its own."""
    rows = df.where(column(group).isNotNull())
    wanted = list(dict.fromkeys(wanted))
    plain = [(f, fn) for f, fn in wanted if fn != MEDIAN]
    out = rows.groupBy(column(group).alias("value")).agg(*[aggregate(fn, column(f)).alias(f"{fn}({f})") for f, fn in plain] or [F.count("*").alias("__rows")])
    for f in [f for f, fn in wanted if fn == MEDIAN]:
        out = out.join(medians(rows, column(f), {"value": column(group)}, f"{MEDIAN}({f})"), "value", "left")
    return out.select("value", *[F.col(f"`{fn}({f})`") for f, fn in wanted])
