"""Statistics of all columns at once, as long tables and as a profile."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column
from gneiss.operators.ranges import quantiles
from gneiss.profile.infer import SCALES, FieldType, infer_types, is_flat, is_id, is_wide_time_series
from gneiss.plans.specs import VizSpec, make
from gneiss.stats import dist

UNIQUE_SHARE = 0.95
CONTIGUOUS_RANGE = 30
QUANTILES = tuple(round(0.05 * i, 2) for i in range(1, 20))


def flat_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_flat(f.dataType)]


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def digest(c: Column) -> Column:
    """128 bits that stand for a value where distinct ones are counted."""
    return F.struct(F.xxhash64(F.lit(1), c).alias("a"), F.xxhash64(F.lit(2), c).alias("b"))


def distinct_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, distinct) of the fields with a value: one scan, and one shuffle of (field, digest, count) rows for all."""
    each = []
    for i, c in enumerate(fields):
        d = digest(column(c))
        each.append(F.struct(F.lit(i).alias("i"), F.when(column(c).isNotNull(), d["a"]).alias("a"), d["b"].alias("b")))
    rows = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("a is not null")
    per = rows.groupBy("i", "a", "b").agg(F.count("*").alias("c")).groupBy("i").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"))
    return per.select(F.array(*[F.lit(c) for c in fields])[F.col("i")].alias("field"), "n", "distinct")


def counts(df: DataFrame) -> DataFrame:
    """(field, n, nulls, distinct) for each flat column, from one scan."""
    fields = flat_fields(df)
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, n long, nulls long, distinct long")
    found = distinct_counts(df, fields)
    every = df.agg(F.count("*").alias("rows")).select("rows", F.explode(F.array(*[F.lit(c) for c in fields])).alias("field"))
    n, distinct = F.coalesce("n", F.lit(0)), F.coalesce("distinct", F.lit(0))
    return every.join(F.broadcast(found), "field", "left").select("field", n.alias("n"), (F.col("rows") - n).alias("nulls"), distinct.alias("distinct"))  # a row a field


def uniqueness(df: DataFrame) -> DataFrame:
    """distinct share of each column and whether it reaches 0.95."""
    share = F.when(F.col("n") > 0, F.col("distinct") / F.col("n"))
    return counts(df).select("field", "n", "distinct", (F.coalesce(share, F.lit(0.0)) >= UNIQUE_SHARE).alias("is_unique"))


def temporal_uniqueness(df: DataFrame, time: str, fields: list[str], times: int = 5) -> DataFrame:
    """whether a field is unique within each of the first few times."""
    first = df.where(column(time).isNotNull()).select(column(time).alias("t")).distinct().orderBy("t").limit(times)
    rows = df.withColumnRenamed(time, "t").join(F.broadcast(first), "t")  # `times` rows
    per = rows.groupBy("t").agg(*[(F.countDistinct(column(f)) / F.count(column(f)) >= UNIQUE_SHARE).alias(f) for f in fields])
    return per.agg(*[F.bool_and(column(f)).alias(f) for f in fields])


def describe_numeric(df: DataFrame, field: str) -> DataFrame:
    """count, mean, sample deviation, extremes and percentiles in steps of five."""
    x = column(field).cast("double")
    one = df.agg(F.count("*").alias("total"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df.select(x.alias("x")), "x", QUANTILES).toDF(*[f"p{round(100 * p):02d}" for p in QUANTILES])
    return one.crossJoin(F.broadcast(q))  # one row each


def describe_categorical(df: DataFrame, field: str) -> DataFrame:
    """count, distinct values, the commonest (the least of equals) and how often it stands."""
    per = df.where(column(field).isNotNull()).groupBy(column(field).alias("v")).agg(F.count("*").alias("n"))
    top = F.max(F.struct(F.col("n").alias("n"))).getField("n")
    return per.agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), top.alias("freq"))


def contiguity(df: DataFrame, fields: list[str]) -> DataFrame:
    """F8: integer fields that miss no value in a range of 30 at most.

    Values of so short a range differ modulo 64, so the bits of one long tell how many there are.
    """
    seen = lambda c: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(column(c), F.lit(64)).cast("int")))
    one = df.agg(*[x for c in fields for x in (F.min(column(c)).alias(f"a:{c}"), F.max(column(c)).alias(f"b:{c}"), F.bit_count(seen(c)).alias(f"d:{c}"))])
    span = lambda c: F.try_add(F.try_subtract(column(f"b:{c}"), column(f"a:{c}")), F.lit(1))
    rows = [F.struct(F.lit(c).alias("field"), F.coalesce((span(c) <= CONTIGUOUS_RANGE + 1) & (span(c) == column(f"d:{c}")), F.lit(False)).alias("contiguous")) for c in fields]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def normality_moments(df: DataFrame, field: str) -> DataFrame:
    """what D'Agostino's test needs: count, population skewness and kurtosis."""
    x = column(field).cast("double")
    return df.agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def normality(df: DataFrame, field: str, alpha: float = 0.05) -> tuple[float | None, bool | None]:
    """p of D'Agostino's K2 and whether it speaks for a normal distribution; null under 8 values."""
    m = normality_moments(df, field).first()
    if m["n"] < 8 or m["skew"] is None:
        return None, None
    p = dist.dagostino(m["n"], m["skew"], m["kurt"])
    return p, p >= alpha


def null_counts(df: DataFrame) -> DataFrame:
    """nulls of each flat column, from one plain aggregation."""
    fields = flat_fields(df)
    one = df.agg(*[F.count_if(column(c).isNull()).alias(f"n:{c}") for c in fields])
    rows = [F.struct(F.lit(c).alias("field"), column(f"n:{c}").alias("nulls")) for c in fields]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def unique_values(df: DataFrame, field: str) -> DataFrame:
    """sorted distinct values as rows."""
    return df.where(column(field).isNotNull()).select(column(field).alias("value")).distinct().orderBy("value")


def dataset_properties(df: DataFrame) -> DataFrame:
    """rows, columns, layout."""
    wide = is_wide_time_series(df.columns)
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit("wide" if wide else "long").alias("structure"), F.lit(wide).alias("is_time_series"))


@dataclass(frozen=True)
class Field:
    """One column of a profile."""

    name: str
    type: str
    general: str
    scale: str
    n: int
    nulls: int
    distinct: int
    unique: bool
    contiguous: bool
    id: bool
    manual: bool = False


def make_field(t: FieldType, n: int, nulls: int, distinct: int, contiguous: bool) -> Field:
    unique = bool(n) and distinct / n >= UNIQUE_SHARE
    scale = "ordinal" if t.type == "integer" and contiguous else t.scale
    return Field(t.name, t.type, t.general, scale, n, nulls, distinct, unique, contiguous, is_id(t.name, t.type, unique))


def profile(df: DataFrame) -> list[Field]:
    """types, counts, contiguity and ids of every flat column, in three jobs: votes on types, one aggregation of
    rows and extremes, and one count of the distinct values of all columns."""
    types = {t.name: t for t in infer_types(df)}
    whole = [c for c in numeric_fields(df) if types[c].type == "integer"]
    one = df.agg(F.count("*").alias("rows"), *[x for c in whole for x in (F.min(column(c)).alias(f"a:{c}"), F.max(column(c)).alias(f"b:{c}"))]).first()
    found = {r["field"]: r for r in distinct_counts(df, list(types)).collect()} if types else {}
    out = []
    for c, t in types.items():
        n, distinct = (found[c]["n"], found[c]["distinct"]) if c in found else (0, 0)
        span = one[f"b:{c}"] - one[f"a:{c}"] + 1 if c in whole and n else None
        out.append(make_field(t, n, one["rows"] - n, distinct, span is not None and span <= CONTIGUOUS_RANGE + 1 and span == distinct))
    return out


def field_chart(f: Field) -> VizSpec | None:
    """the chart of one field's distribution: counts of categories and ordinals, bins of what is continuous, none of an id."""
    if f.id or f.general == "c" and f.unique:
        return None
    if f.general == "c" or f.scale == "ordinal":
        return make("val:count", f.general, ("bar",), f"frequency of {f.name}", field_a=f.name)
    return make("bin:agg", f"b:{f.general}", ("hist",), f"distribution of {f.name}", binning_field=f.name, agg_field_a=f.name, agg_fn="count")


def first_values(df: DataFrame, n: int = 100) -> DataFrame:
    """the first n non-empty values of each flat column as Spark meets them, n rows a column at most."""
    out = None
    for c in flat_fields(df):
        text = column(c).cast("string")
        one = df.where(text.isNotNull() & (F.trim(text) != "")).select(F.lit(c).alias("field"), text.alias("value")).limit(n)
        out = one if out is None else out.union(one)
    return out


def delimited_lists(df: DataFrame, fields: list[str], delimiter: str = ",", least: float = 0.8) -> DataFrame:
    """whether most of a field's values are lists: two or more parts, none empty."""
    rows = []
    for c in fields:
        parts = F.split(column(c).cast("string"), F.lit("\\Q" + delimiter + "\\E"))
        is_list = (F.size(parts) > 1) & ~F.exists(parts, lambda p: F.trim(p) == "")
        share = F.coalesce(F.avg(F.when(column(c).isNotNull(), is_list.cast("double"))), F.lit(0.0))
        rows.append(F.struct(F.lit(c).alias("field"), share.alias("share"), (share >= least).alias("is_list")))
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def even_skips(values: list, n: int) -> list:
    """N values of a list at even distances, the first always."""
    return list(values) if len(values) <= n else [values[i * len(values) // n] for i in range(n)]


def override(fields: list[Field], name: str, type: str | None = None, id: bool | None = None) -> list[Field]:
    """a profile with one column's type or id mark set by hand; what follows from the type is set anew."""
    from gneiss.profile.infer import GENERAL, WEIGHTS

    known = set(WEIGHTS) | {"text", "url", "city", "date", "time"}
    if type is not None and type not in known:
        raise ValueError(f"unknown type {type!r}")
    out = []
    for f in fields:
        if f.name == name:
            f = replace(f, manual=True)
            if type is not None:
                f = replace(f, type=type, general=GENERAL.get(type, "c"), scale="ordinal" if type == "integer" and f.contiguous else SCALES.get(type, "nominal"))
            if id is not None:
                f = replace(f, id=id)
        out.append(f)
    return out
