"""Order over a whole table without sorting it in one task: ranges of the keys by fixed bounds.

The bounds are taken from a bounded sample of rows, so a key that many rows have gets many ranges: behind the keys,
rows are told apart by a hash of their other columns. A row's range is an expression of its own columns, so two uses
of it always agree, whatever Spark does with partitions. Each range is then sorted by itself and starts from the sum
of those before it. Equal rows share a range; count them first where there may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 4096  # bounds that the plan holds; beyond 4 * 10^9 rows a task sorts more than ROWS_PER_RANGE, with spills
SAMPLES_PER_RANGE = 16
TIE = "__tie"


def with_tie(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return df.withColumn(TIE, F.xxhash64(*others) if others else F.lit(0).cast("long"))


def bounds_below(bounds: Sequence[Column], key: Column) -> Column:
    """How many of the sorted bounds are at or below the key: a binary search."""
    table, steps = F.array(*bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    within = lambda at, step: (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: at + F.when(within(at, step), step).otherwise(0))


def with_bounds_below(df: DataFrame, bounds: Sequence[Column], key: Column, name: str) -> DataFrame:
    """df with bounds_below as a column: a projection for each step of the search, which Spark compiles, unlike one over arrays."""
    table, found, place = F.array(*bounds), "__found", df.withColumn("__found", F.lit(0))
    for step in [1 << i for i in reversed(range(len(bounds).bit_length()))]:
        at = F.col(found)
        within = (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key)
        place = place.withColumn(found, at + F.when(within, step).otherwise(0))
    return place.withColumnRenamed(found, name)


def placed(df: DataFrame, keys: Sequence[str], name: str = "part") -> DataFrame:
    """df with the tie hash and the number of each row's range, in the order of the keys and then the hash."""
    rows = with_tie(df, keys)
    n = rows.count()
    ranges = min(MAX_RANGES, n // ROWS_PER_RANGE + 1)
    if ranges == 1:
        return rows.withColumn(name, F.lit(0))
    order = [*keys, TIE]
    key = F.struct(*[F.col(k) for k in order])
    share = min(1.0, SAMPLES_PER_RANGE * ranges / n)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), *order), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = [r["k"] for r in drawn.select(key.alias("k")).orderBy("k").collect()]  # about SAMPLES_PER_RANGE * MAX_RANGES keys at most
    kinds = [rows.schema[k].dataType for k in order]
    chosen = list(dict.fromkeys(sample[len(sample) * i // ranges] for i in range(1, ranges))) if sample else []
    if not chosen:
        return rows.withColumn(name, F.lit(0))
    bounds = [F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(b, kinds, order, strict=True)]) for b in chosen]
    return with_bounds_below(rows, bounds, key, name)


def with_sums_before(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """df with, for each name in sums, the sum of the expression over all rows before this one in the keys' order (of the same `by`)."""
    part = "__part"
    rows = placed(df.withColumns({f"__{n}": e for n, e in sums.items()}), keys, part)
    totals = rows.groupBy(*by, part).agg(*[F.sum(f"__{n}").alias(f"__t{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, part, *[F.coalesce(F.sum(f"__t{n}").over(earlier), F.lit(0)).alias(f"__b{n}") for n in sums])  # MAX_RANGES rows for each `by`
    inside = Window.partitionBy(*by, part).orderBy(*keys, TIE).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"__i{n}": F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in sums})
    joined = own.join(base, [*by, part])
    return joined.select(*df.columns, *[(F.col(f"__b{n}") + F.col(f"__i{n}")).alias(n) for n in sums])


def counted(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, __n): how often each value stands, nulls left out."""
    return df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__n"))


def few_values(df: DataFrame, x: str, by: Sequence[str] = ()) -> bool:
    """Whether a table has ROWS_PER_RANGE distinct (by, x) at most, or about so many; a count of rows that is as low settles it."""
    if df.count() <= ROWS_PER_RANGE:
        return True
    return df.agg(F.approx_count_distinct(F.xxhash64(*by, x), 0.02)).first()[0] <= ROWS_PER_RANGE


def quantiles(df: DataFrame, x: str, shares: Sequence[float], by: Sequence[str] = (), more: dict[str, Column] | None = None) -> DataFrame:
    """One row (for each `by`) with q0, q1, ...: exact quantiles of x, interpolated between neighbours.

    Values are counted first. About ROWS_PER_RANGE distinct ones are put in order within their `by`; more, range by
    range. more: further aggregates over the counted values (x, __n).
    """
    per, more = counted(df, x, by), more or {}
    size = F.sum("__n").alias("__size")
    if few_values(df, x, by):
        whole = Window.partitionBy(*by)
        inside = whole.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        rows = per.select("*", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__size"))
    else:
        ordered = with_sums_before(per, [x], {"__before": F.col("__n")}, by)
        sizes = per.groupBy(*by).agg(size)
        rows = ordered.join(sizes, list(by)) if by else ordered.crossJoin(F.broadcast(sizes))  # one row
    at = [(F.lit(p) * (F.col("__size") - 1)) for p in shares]
    held = lambda place: F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("__n")), F.col(x)))
    ends = rows.groupBy(*by, "__size").agg(*[e.alias(f"__{s}{i}") for i, a in enumerate(at) for s, e in (("l", held(F.floor(a))), ("h", held(F.ceil(a))))], *[e.alias(n) for n, e in more.items()])
    value = lambda i, a: (F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (a - F.floor(a))).cast("double")
    out = ends.select(*by, *[value(i, a).alias(f"q{i}") for i, a in enumerate(at)], *more)
    return out if by else df.sparkSession.range(1).select().join(out, F.lit(True), "left")
