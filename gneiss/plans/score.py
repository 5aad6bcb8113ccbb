"""Attach data to specs, drop empty ones, score and rank."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.predicates import column
from gneiss.operators.ranges import counted, with_sums_before
from gneiss.plans.compile import compile_batch
from gneiss.plans.specs import ScoredSpec, VizSpec

SCORED = ("c:q", "b:q", "[c]:q")
LEAST_ROWS = 2
RESULT_ROWS = 5000
AT_ONCE = 4


def entropy(values: Sequence[float]) -> float | None:
    """Shannon's, base e, of the values' shares."""
    total = sum(values)
    if not values or total <= 0 or min(values) < 0:
        return None
    return -sum(v / total * math.log(v / total) for v in values if v > 0)


def dispersion(values: Sequence[float]) -> float | None:
    """Population variance over the maximum."""
    top = max(values, default=0)
    if not top:
        return None
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values) / top


def gini(values: Sequence[float]) -> float | None:
    """Inequality of non-negative values: 0 for equal ones."""
    total = sum(values)
    if not values or total <= 0:
        return None
    n = len(values)
    return sum((2 * i - n + 1) * v for i, v in enumerate(sorted(values))) / (n * total)


def gini_of(df: DataFrame, field: str) -> DataFrame:
    """(n, gini) of a whole column of non-negative numbers, from counted values placed by ranges; nulls left out, null where all are 0."""
    x = column(field).cast("double")
    per = with_sums_before(counted(df.select(x.alias("x")), "x"), ["x"], {"before": F.col("__n")})
    # the c copies of a value stand at places b + 1 to b + c, whose sum is c * (2 * b + c + 1) / 2
    terms = per.agg(F.sum("__n").alias("n"), F.sum(F.col("x") * F.col("__n")).alias("total"), F.sum(F.col("x") * F.col("__n") * (2 * F.col("before") + F.col("__n"))).alias("placed"))
    return terms.select("n", F.when(F.col("total") > 0, F.col("placed") / (F.col("n") * F.col("total")) - 1).alias("gini"))


def relevance(spec: VizSpec, selected: Sequence[str]) -> float:
    return len(set(spec.fields) & set(selected)) / len(selected) if selected else 0.0


def correlation(pairs: Sequence[tuple[float, float]]) -> float | None:
    n = len(pairs)
    if n < 2:
        return None
    mx, my = (sum(p[i] for p in pairs) / n for i in (0, 1))
    sx, sy = (math.sqrt(sum((p[i] - m) ** 2 for p in pairs)) for i, m in ((0, mx), (1, my)))
    return sum((x - mx) * (y - my) for x, y in pairs) / (sx * sy) if sx and sy else None


def _measured(spec: VizSpec, columns: Sequence[str]) -> str | None:
    return next((c for c in ("agg", "agg_a", "median", "b") if c in columns), None) if spec.structure in SCORED else None


def statistics(spec: VizSpec, rows: Sequence[Mapping]) -> dict[str, float | None]:
    """Scores of a whole result that is at hand."""
    if spec.structure == "q:q":
        return {"correlation": correlation([(r["a"], r["b"]) for r in rows])}
    if spec.structure not in SCORED:
        return {}
    name = _measured(spec, list(rows[0].asDict()) if rows else [])
    values = [float(r[name]) for r in rows if r[name] is not None] if name else []
    return {"entropy": entropy(values), "dispersion": dispersion(values), "size": float(len(rows))}


def statistics_of(spec: VizSpec, plan: DataFrame) -> dict[str, float | None]:
    """The same scores of a result of any size, by one aggregation."""
    if spec.structure == "q:q":
        return {"correlation": plan.agg(F.corr(F.col("a").cast("double"), F.col("b").cast("double"))).first()[0]}
    if spec.structure not in SCORED:
        return {}
    name = _measured(spec, plan.columns)
    if not name:
        return {"entropy": None, "dispersion": None, "size": float(plan.count())}
    v = F.col(name).cast("double")
    r = plan.agg(F.count("*").alias("size"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.var_pop(v).alias("var"), F.sum(F.when(v > 0, v * F.log(v))).alias("vlog")).first()
    fit = r["sum"] is not None and r["sum"] > 0 and r["min"] >= 0
    return {"entropy": math.log(r["sum"]) - r["vlog"] / r["sum"] if fit else None, "dispersion": r["var"] / r["max"] if r["max"] else None, "size": float(r["size"])}


def recommend(
    df: DataFrame, specs: Sequence[VizSpec], selected: Sequence[str] = (), conditionals: Mapping | None = None, seconds: float | None = None, errors: dict[VizSpec, Exception] | None = None, at_once: int = AT_ONCE
) -> list[tuple[ScoredSpec, list]]:
    """Scored specs with their result rows, most relevant first. A result with no more than one row is left out, but for pair counts.

    Scores are of the whole result; RESULT_ROWS of its rows are returned for display. `at_once` specs are
    asked of Spark at a time. One that fails goes to errors, and the others go on; after `seconds` no further one starts.
    """
    began = time.monotonic()
    errors = {} if errors is None else errors
    batch = compile_batch(specs, df, conditionals, errors)

    def one(item: tuple[VizSpec, DataFrame]) -> tuple[ScoredSpec, list] | None:
        spec, plan = item
        if seconds is not None and time.monotonic() - began > seconds:
            return None
        try:
            rows = plan.limit(RESULT_ROWS + 1).collect()
            scores = statistics(spec, rows) if len(rows) <= RESULT_ROWS else statistics_of(spec, plan)
        except Exception as e:  # one bad spec must not end the others
            errors[spec] = e
            return None
        if len(rows) < LEAST_ROWS and spec.procedure != "multigroup:count":
            return None
        return ScoredSpec(spec, relevance(spec, selected), tuple(scores.items())), rows[:RESULT_ROWS]

    with ThreadPoolExecutor(at_once) as pool:
        out = [x for x in pool.map(one, batch.items()) if x is not None]
    batch.release()
    return sorted(out, key=lambda x: -x[0].relevance)
