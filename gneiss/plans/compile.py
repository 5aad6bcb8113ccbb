"""Spec -> DataFrame, and many specs in few jobs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import groupings as g
from gneiss.operators.binning import histogram
from gneiss.operators.predicates import column, filtered
from gneiss.plans.specs import VizSpec


def compile_spec(spec: VizSpec, df: DataFrame, conditionals: Mapping | None = None, config: Mapping | None = None) -> DataFrame:
    """The long-form result of one spec over the rows that meet the conditionals."""
    rows, a, conf = filtered(df, conditionals), dict(spec.args), config or {}
    limit = conf.get("subset", g.CHART_LIMIT)
    limit = None if limit in ("all", 0, None) else limit
    match spec.procedure:
        case "agg":
            return g.single(rows, a["agg_field_a"], a["agg_fn"])
        case "ind:val":
            return g.indexed_values(rows, a["field_a"], conf.get("order", [a["field_a"]]))
        case "val:count":
            return g.value_counts(rows, a["field_a"], limit)
        case "val:agg":
            return g.value_aggregate(rows, a["grouped_field"], a["agg_field"], a["agg_fn"])
        case "val:box":
            return g.box(rows, a["grouped_field"], a["boxed_field"])
        case "val:val":
            return g.value_pairs(rows, a["field_a"], a["field_b"], conf.get("pairs", 200))
        case "agg:agg":
            return g.aggregate_pairs(rows, a["grouped_field"], a["agg_field_a"], a["agg_field_b"], a["agg_fn"])
        case "multigroup:count":
            return g.multigroup(rows, a["field_a"], a["field_b"])
        case "multigroup:agg":
            return g.multigroup(rows, a["grouped_field_a"], a["grouped_field_b"], a["agg_field"], a["agg_fn"])
        case "bin:agg" | "bin:count":
            field = a.get("agg_field_a")
            fn = a.get("agg_fn", "count")
            return histogram(rows, a["binning_field"], None if fn == "count" else field, fn, bins=conf.get("num_bins"), procedure=conf.get("binning_procedure", "freedman"))
        case "val:val:q":
            return g.edges(rows, a["field_a"], a["field_b"], a["agg_field"])
    raise ValueError(f"no plan for {spec.procedure!r}")


SHARED_ROWS = 20_000
MAX_SETS = 8


class Batch(dict):
    """Plans by spec. Those that read a shared table of over SHARED_ROWS rows read a cached one; release() frees it."""

    def __init__(self):
        super().__init__()
        self.shared: list[DataFrame] = []

    def release(self) -> None:
        for table in self.shared:
            table.unpersist()
        self.shared = []


_PAIRS = ("multigroup:count", "multigroup:agg", "val:val:q")


def _key(s: VizSpec) -> tuple[str, ...] | None:
    """What a spec groups by, where it can share a pass; a median has its own way."""
    if s.arg("agg_fn") == g.MEDIAN:
        return None
    if s.procedure in ("val:agg", "agg:agg"):
        return (s.arg("grouped_field"),)
    if s.procedure == "val:count":
        return (s.arg("field_a"),)
    if s.procedure in _PAIRS:
        return tuple(sorted((s.arg("grouped_field_a") or s.arg("field_a"), s.arg("grouped_field_b") or s.arg("field_b"))))
    return None


def _measures(s: VizSpec) -> dict[str, Column]:
    """The aggregates that a spec needs of the shared pass, by name."""
    if s.procedure in ("val:count", "multigroup:count"):
        return {"count": F.count("*")}
    if s.procedure == "val:val:q":
        return {"count": F.count("*"), f"sum({s.arg('agg_field')})": F.sum(column(s.arg("agg_field")))}
    fn = s.arg("agg_fn")
    if s.procedure == "agg:agg":
        a, b = s.arg("agg_field_a"), s.arg("agg_field_b")
        both = column(a).isNotNull() & column(b).isNotNull()
        return {f"{fn}({x} with {y})": g.aggregate(fn, F.when(both, column(x))) for x, y in ((a, b), (b, a))} | {f"count({a} with {b})": F.count(F.when(both, column(a)))}
    x = s.arg("agg_field")
    return {f"{f}({x})": g.aggregate(f, column(x)) for f in (fn, "count", *(["sem"] if fn == "mean" else []))}


def _share(s: VizSpec, table: DataFrame) -> DataFrame:
    """One spec's rows out of the shared table, as compile_spec gives them."""
    c = lambda name: F.col(f"`{name}`")
    if s.procedure == "val:count":
        return table.select(c("k0").alias("value"), "count").orderBy(F.desc("count"), "value").limit(g.CHART_LIMIT)
    fn = s.arg("agg_fn")
    if s.procedure == "agg:agg":
        a, b = s.arg("agg_field_a"), s.arg("agg_field_b")
        return table.where(c(f"count({a} with {b})") > 0).select(c("k0").alias("value"), c(f"{fn}({a} with {b})").alias("agg_a"), c(f"{fn}({b} with {a})").alias("agg_b"))
    key = _key(s)
    if s.procedure in _PAIRS:
        first = s.arg("grouped_field_a") or s.arg("field_a")
        ends = [c("k0"), c("k1")] if key[0] == first else [c("k1"), c("k0")]
        if s.procedure == "multigroup:count":
            return table.select(ends[0].alias("a"), ends[1].alias("b"), "count")
        if s.procedure == "val:val:q":
            return table.select(ends[0].alias("source"), ends[1].alias("target"), c(f"sum({s.arg('agg_field')})").alias("weight"), "count")
        groups = [ends[0].alias("a"), ends[1].alias("b")]
    else:
        groups = [c("k0").alias("value")]
    x = s.arg("agg_field")
    mean, sem = c(f"{fn}({x})"), c(f"sem({x})")
    out = [mean.alias("agg")]
    if fn == "mean":
        out += [(mean - sem).alias("lower"), (mean + sem).alias("upper")]
        if s.procedure == "multigroup:agg":
            out.append(F.format_string("%.3f ± %.3f", mean, sem).alias("cell"))
    return table.where(c(f"count({x})") > 0).select(*groups, *out)


def _shared_table(rows: DataFrame, keys: Sequence[tuple[str, ...]], specs: Sequence[VizSpec], out: Batch) -> dict[tuple[str, ...], DataFrame]:
    """All measures of the specs for all their key sets, from one pass with GROUPING SETS; a view for each key set."""
    fields = list(dict.fromkeys(f for k in keys for f in k))
    measures = {n: e for s in specs for n, e in _measures(s).items()}
    names = list(measures)
    sets = [[column(f) for f in k] for k in keys]
    grouped = rows.groupingSets(sets, *[column(f) for f in fields]).agg(F.grouping_id().alias("set"), *[e.alias(f"m{i}") for i, e in enumerate(measures.values())])
    table = grouped.toDF(*[f"f{i}" for i in range(len(fields))], "set", *names)
    # few rows, as charts have, are kept on the driver, where plans over them need no job; more are cached
    got = table.limit(SHARED_ROWS + 1).toArrow()
    if got.num_rows <= SHARED_ROWS:
        table = rows.sparkSession.createDataFrame(got, table.schema)
    else:
        out.shared.append(table.cache())
    views = {}
    for key in keys:
        left_out = sum(1 << (len(fields) - 1 - i) for i, f in enumerate(fields) if f not in key)
        mine = table.where(F.col("set") == left_out).select(*[F.col(f"f{fields.index(f)}").alias(f"k{i}") for i, f in enumerate(key)], *[F.col(f"`{n}`") for n in names])
        views[key] = mine.na.drop("any", subset=[f"k{i}" for i in range(len(key))])
    return views


def compile_batch(specs: Sequence[VizSpec], df: DataFrame, conditionals: Mapping | None = None, errors: dict[VizSpec, Exception] | None = None) -> Batch:
    """Plans of many specs. All that only group and aggregate share one pass over the rows, MAX_SETS sets of keys at a time; it runs here.

    A shared table has a row per group. With errors, a spec that has no plan over these rows goes there; without, it raises.
    """
    rows = filtered(df, conditionals)
    by_key: dict[tuple[str, ...], list[VizSpec]] = defaultdict(list)
    for s in dict.fromkeys(specs):
        if (key := _key(s)) is not None and len(set(key)) == len(key):
            by_key[key].append(s)

    def has_plan(s: VizSpec) -> bool:
        try:
            rows.groupBy(*[column(f) for f in _key(s)]).agg(*_measures(s).values())
        except AnalysisException:
            return False
        return True

    out, fused = Batch(), {}

    def share(keys: list[tuple[str, ...]]) -> None:
        views = _shared_table(rows, keys, [s for k in keys for s in by_key[k]], out)
        fused.update({s: _share(s, views[k]) for k in keys for s in by_key[k]})

    keys = list(by_key) if sum(map(len, by_key.values())) > 1 else []
    for at in range(0, len(keys), MAX_SETS):
        some = keys[at : at + MAX_SETS]
        try:
            share(some)
        except AnalysisException:  # one of them has no plan: the others share one
            for k in some:
                by_key[k] = [s for s in by_key[k] if has_plan(s)]
            if some := [k for k in some if by_key[k]]:
                share(some)
    for s in specs:
        try:
            out[s] = fused[s] if s in fused else compile_spec(s, rows)
        except (AnalysisException, ValueError, KeyError) as e:
            if errors is None:
                raise
            errors[s] = e
    return out
