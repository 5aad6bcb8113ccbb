"""One- and two-way contingency tables with totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.binning import as_number, bin_edges, bin_index, bin_stats, number_of_bins
from gneiss.operators.predicates import column, filtered

DEFAULT_BINS = 3
MAX_CELLS = 100_000


def measure(fn: str, field: str | None = None, weight: str | None = None, share_of=None) -> Column:
    """COUNT, SUM, MEAN, weighted MEAN, or the SHARE of rows whose field is one value."""
    if fn == "COUNT":
        return F.count("*")
    x = column(field)
    if fn == "SUM":
        return F.sum(x)
    if fn == "MEAN":
        return F.avg(x) if weight is None else F.sum(x * column(weight)) / F.sum(F.when(x.isNotNull(), column(weight)))
    if fn == "SHARE":
        return F.avg((x == F.lit(share_of)).cast("double"))
    raise ValueError(f"unknown aggregation function {fn!r}")


def key(df: DataFrame, field: str, edges: Sequence[float] | None) -> Column:
    """A category, or the number of its bin (l, r]."""
    return column(field) if edges is None else bin_index(as_number(df, field), list(edges), right_closed=True)


def crosstab1(df: DataFrame, field: str, fn: str = "COUNT", dependent: str | None = None, weight: str | None = None, share_of=None, edges: Sequence[float] | None = None) -> DataFrame:
    """A row per category; total is null for means, which have none."""
    rows = df.na.drop("any", subset=[x for x in (field, dependent, weight) if x])
    out = rows.groupBy(key(df, field, edges).alias("key")).agg(measure(fn, dependent, weight, share_of).alias("value"))
    if fn in ("MEAN", "SHARE"):
        return out
    total = rows.agg(measure(fn, dependent).alias("total"))
    return out.join(F.broadcast(total))  # one row


def crosstab2(df: DataFrame, rows: str, cols: str, fn: str = "COUNT", dependent: str | None = None, weight: str | None = None, row_edges=None, col_edges=None) -> DataFrame:
    """A row per pair, every pair of categories present, 0 where empty."""
    data = df.na.drop("any", subset=[x for x in (rows, cols, dependent, weight) if x])
    keyed = data.withColumns({"__r": key(df, rows, row_edges), "__c": key(df, cols, col_edges)})
    got = keyed.groupBy("__r", "__c").agg(measure(fn, dependent, weight).alias("value"))
    cells = got.limit(MAX_CELLS + 1).collect()  # a row for each pair that occurs
    sides = [list(dict.fromkeys(r[i] for r in cells)) for i in (0, 1)]
    if len(cells) > MAX_CELLS or len(sides[0]) * len(sides[1]) > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} cells; crosstab2_totals gives only those that occur")
    value = {(r[0], r[1]): r[2] for r in cells}
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(("row", "col", "value"), got.schema, strict=True)])
    grid = df.sparkSession.createDataFrame([(a, b, value.get((a, b))) for a in sides[0] for b in sides[1]], schema)  # MAX_CELLS rows at most
    return grid.select("row", "col", F.coalesce("value", F.lit(0)).alias("value"))


def crosstab2_totals(df: DataFrame, rows: str, cols: str, fn: str = "COUNT", dependent: str | None = None) -> DataFrame:
    """Cells, row totals, column totals and the grand total in one CUBE; level 0 is a cell, 3 the grand total."""
    data = df.na.drop("any", subset=[x for x in (rows, cols, dependent) if x]).select(column(rows).alias("row"), column(cols).alias("col"), *([column(dependent)] if dependent else []))
    return data.cube("row", "col").agg(F.grouping_id().cast("int").alias("level"), measure(fn, dependent).alias("value"))


def run_aggregation(df: DataFrame, variables: Sequence[str], dependent: str | None = None, config: Mapping | None = None, conditionals: Mapping | None = None) -> DataFrame | None:
    """The table for one or two variables, continuous ones binned; None for any other number."""
    config = config or {}
    rows = filtered(df, conditionals)
    fn = config.get("function", "COUNT" if dependent is None else "SUM")

    def edges(field: str, at: int):
        kind = rows.schema[field].dataType.typeName()
        bins = config.get("binning", {}).get(at, {})
        if kind not in ("double", "float", "decimal") and not bins:
            return None
        s = bin_stats(rows, field)
        k = number_of_bins(s, bins.get("procedure", "freedman")) if bins.get("type") == "procedural" else bins.get("num_bins", DEFAULT_BINS)
        return bin_edges(s, k)

    if len(variables) == 1:
        return crosstab1(rows, variables[0], fn, dependent, config.get("weight"), config.get("share_of"), edges(variables[0], 0))
    if len(variables) == 2:
        return crosstab2(rows, variables[0], variables[1], fn, dependent, config.get("weight"), edges(variables[0], 0), edges(variables[1], 1))
    return None
