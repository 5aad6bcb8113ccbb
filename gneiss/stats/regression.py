"""Linear models from one Gram matrix, logistic models, recommendation, curve fits.

A design is a list of terms over columns. One aggregation sums the products of all pairs of term
columns; every sub-model is then a solve of a sub-matrix on the driver, which holds terms squared and
never rows. Terms are centred and scaled first, for conditioning.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column, filtered
from gneiss.stats import dist

MAX_LEVELS = 200
MODEL_LIMIT, LEAST_GAIN = 5, 0.1


@dataclass(frozen=True)
class Term:
    """One design column: its variable (or variables, for interactions) and its label."""

    variable: str
    label: str
    expr: Column


def is_categorical(df: DataFrame, field: str) -> bool:
    return not isinstance(df.schema[field].dataType, T.NumericType)


def levels(df: DataFrame, field: str) -> list[str]:
    got = [r[0] for r in df.where(column(field).isNotNull()).select(column(field).cast("string").alias("v")).distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
    if len(got) > MAX_LEVELS:
        raise ValueError(f"{field} has over {MAX_LEVELS} levels")
    return got


def transform(df: DataFrame, field: str, how: str) -> list[tuple[str, Column]]:
    """linear: x; square: x and x squared; log: ln(x + a hundredth of the least nonzero x)."""
    x = column(field).cast("double")
    if how == "log":
        least = df.agg(F.min(F.when(x != 0, x))).first()[0] or 0.0
        return [(f"log({field})", F.when(x + 0.01 * least > 0, F.log(x + 0.01 * least)))]
    if how == "square":
        return [(field, x), (f"{field}^2", x * x)]
    return [(field, x)]


def field_terms(df: DataFrame, field: str, how: str = "linear") -> list[Term]:
    """Numbers as they are or transformed; categories as indicators of all levels but the first."""
    if is_categorical(df, field):
        return [Term(field, f"{field}[{v}]", (column(field).cast("string") == v).cast("double")) for v in levels(df, field)[1:]]
    return [Term(field, label, e) for label, e in transform(df, field, how)]


def interaction(parts: Sequence[Sequence[Term]]) -> list[Term]:
    """Products of one term of each part."""
    out = list(parts[0])
    for p in parts[1:]:
        out = [Term(f"{a.variable}:{b.variable}", f"{a.label}:{b.label}", a.expr * b.expr) for a in out for b in p]
    return out


@dataclass
class Gram:
    """Sums of products of [1, terms..., y] over complete rows, in standardised units."""

    terms: list[Term]
    mean: np.ndarray
    scale: np.ndarray
    cross: np.ndarray
    n: float


def gram(df: DataFrame, y: Column, terms: Sequence[Term], weight: Column | None = None) -> Gram:
    """Two aggregations: means and deviations, then all products. Rows with a null anywhere go."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    names = [f"z{i}" for i in range(len(terms) + 1)]
    z = df.select(*[t.expr.alias(n) for t, n in zip(terms, names, strict=False)], y.cast("double").alias(names[-1]), w.alias("w")).na.drop("any")
    one = z.agg(F.sum("w").alias("n"), *[x for n in names for x in ((F.sum(F.col(n) * F.col("w")) / F.sum("w")).alias(f"m{n}"), F.stddev_pop(n).alias(f"s{n}"))]).first()
    mean = np.array([one[f"m{n}"] or 0.0 for n in names])
    scale = np.array([one[f"s{n}"] or 1.0 for n in names])
    c = [(F.col(n) - float(m)) / float(s) for n, m, s in zip(names, mean, scale, strict=True)]
    k = len(c)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = z.agg(*[F.sum(c[i] * c[j] * F.col("w")).alias(f"{i}_{j}") for i, j in pairs]).first()
    cross = np.zeros((k, k))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = got[f"{i}_{j}"] or 0.0
    return Gram(list(terms), mean, scale, cross, float(one["n"] or 0))


@dataclass
class Fit:
    """A linear model: (label, coefficient, standard error, t, p, low, high) rows and its summary."""

    rows: list[tuple]
    n: float
    df: float
    r2: float
    adj_r2: float
    f: float | None
    f_p: float | None
    aic: float
    bic: float
    rss: float


def solve(g: Gram, keep: Sequence[int] | None = None) -> Fit:
    """Least squares of the last column on the kept terms and an intercept."""
    keep = list(range(len(g.terms)) if keep is None else keep)
    a, b = g.cross[np.ix_(keep, keep)], g.cross[keep, -1]
    inverse = np.linalg.pinv(a, hermitian=True) if keep else np.zeros((0, 0))
    rank = int(np.linalg.matrix_rank(a, hermitian=True)) if keep else 0
    beta = inverse @ b
    sy = g.scale[-1]
    total = g.cross[-1, -1] * sy * sy
    rss = max(0.0, (g.cross[-1, -1] - float(b @ beta)) * sy * sy)
    df = g.n - rank - 1
    sigma2 = rss / df if df > 0 else math.nan
    coef = beta * sy / g.scale[keep]
    d = 1 / g.scale[keep]
    cov = sigma2 * inverse * np.outer(d, d)
    intercept = g.mean[-1] - float(coef @ g.mean[keep])
    var0 = sigma2 / g.n + float(g.mean[keep] @ cov @ g.mean[keep])
    half = dist.t_ppf2(0.05, df) if df > 0 else math.nan
    rows = []
    for label, c, v in [("intercept", intercept, var0), *((g.terms[i].label, float(c), float(v)) for i, c, v in zip(keep, coef, np.diag(cov), strict=True))]:
        se = math.sqrt(max(v, 0.0)) if v == v else math.nan
        t = c / se if se else math.nan
        rows.append((label, c, se, t, dist.t_sf2(t, df) if t == t else math.nan, c - half * se, c + half * se))
    r2 = 1 - rss / total if total else 0.0
    adj = 1 - (1 - r2) * (g.n - 1) / df if df > 0 else math.nan
    f = (r2 / rank) / ((1 - r2) / df) if rank and df > 0 and r2 < 1 else None
    llf = -g.n / 2 * (math.log(2 * math.pi) + math.log(rss / g.n) + 1) if rss > 0 else math.inf
    return Fit(rows, g.n, df, r2, adj, f, dist.f_sf(f, rank, df) if f is not None else None, -2 * llf + 2 * (rank + 1), -2 * llf + math.log(g.n) * (rank + 1) if g.n else math.nan, rss)


def layouts(variables: Sequence[str], layout: str) -> list[list[str]]:
    """Which models a table shows: all; one at a time and all; all and each without one."""
    everything = list(variables)
    if layout == "all" or len(everything) < 2:
        return [everything]
    if layout == "one_at_a_time":
        return [[v] for v in everything] + [everything]
    if layout == "leave_one_out":
        return [[w for w in everything if w != v] for v in everything] + [everything]
    raise ValueError(f"unknown table layout {layout!r}")


def design(df: DataFrame, independents: Sequence[str], transformations: Mapping[str, str] | None = None, interactions: Sequence[Sequence[str]] = (), degree: int = 1) -> list[Term]:
    how = transformations or {}
    own = {f: field_terms(df, f, how.get(f, "linear")) for f in dict.fromkeys([*independents, *(x for i in interactions for x in i)])}
    terms = [t for f in independents for t in own[f]]
    if degree > 1:
        terms += [Term(f, f"{f}^{k}", F.pow(column(f).cast("double"), F.lit(k))) for f in independents if not is_categorical(df, f) for k in range(2, degree + 1)]
    return terms + [t for i in interactions for t in interaction([own[f] for f in i])]


def regress(df: DataFrame, dependent: str, independents: Sequence[str], conditionals: Mapping | None = None, layout: str = "leave_one_out", transformations: Mapping[str, str] | None = None, interactions: Sequence[Sequence[str]] = (), degree: int = 1, weight: str | None = None) -> list[tuple[list[str], Fit]]:
    """The models of a layout, all solved from one Gram matrix over complete rows."""
    rows = filtered(df, conditionals)
    terms = design(rows, independents, transformations, interactions, degree)
    g = gram(rows, column(dependent), terms, None if weight is None else column(weight))
    names = [*independents, *(":".join(i) for i in interactions)]
    return [(m, solve(g, [i for i, t in enumerate(terms) if t.variable in m])) for m in layouts(names, layout)]


def r2_contributions(models: Sequence[tuple[list[str], Fit]]) -> dict[str, float]:
    """What each variable adds to the full model's adjusted R2."""
    full_names, full = max(models, key=lambda m: len(m[0]))
    return {next(iter(set(full_names) - set(names))): full.adj_r2 - fit.adj_r2 for names, fit in models if len(names) == len(full_names) - 1}


def anova(df: DataFrame, dependent: str, independents: Sequence[str]) -> list[tuple[str, int, float, float, float | None, float | None]]:
    """H2: sequential (type I) table of the factors and one term for all of them together: (source, df, SS, MS, F, p), residual last."""
    cats = {f: [Term(f, f"{f}[{v}]", (column(f).cast("string") == v).cast("double")) for v in levels(df, f)[1:]] for f in independents}
    terms = [t for f in independents for t in cats[f]] + (interaction([cats[f] for f in independents]) if len(independents) > 1 else [])
    g = gram(df, column(dependent), terms)
    names = [*independents, *([":".join(independents)] if len(independents) > 1 else [])]
    fits, used = [solve(g, [])], []
    for n in names:
        used = used + [i for i, t in enumerate(terms) if t.variable == n]
        fits.append(solve(g, used))
    last = fits[-1]
    mse = last.rss / last.df
    out = []
    for n, a, b in zip(names, fits, fits[1:], strict=False):
        k, ss = int(a.df - b.df), a.rss - b.rss
        f = ss / k / mse if k else None
        out.append((n, k, ss, ss / k if k else 0.0, f, dist.f_sf(f, k, last.df) if f is not None else None))
    return [*out, ("residual", int(last.df), last.rss, mse, None, None)]


def logistic(df: DataFrame, dependent: Column, independents: Sequence[str], transformations: Mapping[str, str] | None = None) -> tuple[list[tuple], dict[str, float]]:
    """Binary logit by iteratively reweighted least squares: (label, coefficient, SE, z, p) and the summary."""
    terms = design(df, independents, transformations)
    rows = df.select(*[t.expr.alias(f"x{i}") for i, t in enumerate(terms)], dependent.cast("double").alias("label")).na.drop("any")
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(terms))], outputCol="features").transform(rows).select("features", "label")
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50).fit(data)
    s = model.summary
    labels = [*(t.label for t in terms), "intercept"]
    table = list(zip(labels, [*model.coefficients, model.intercept], s.coefficientStandardErrors, s.tValues, s.pValues, strict=True))
    llf, llnull = -s.deviance / 2, -s.nullDeviance / 2
    k = len(terms)
    return table, {"n": s.numInstances, "llf": llf, "llnull": llnull, "r2": 1 - llf / llnull, "llr_p": dist.chi2_sf(2 * (llf - llnull), k), "aic": s.aic, "bic": -2 * llf + math.log(s.numInstances) * (k + 1)}


def multinomial(df: DataFrame, dependent: str, independents: Sequence[str], transformations: Mapping[str, str] | None = None) -> tuple[list[tuple], dict[str, float]]:
    """Logit of several classes against the first by name: (class, label, coefficient, SE, z, p) and the summary.

    Coefficients come from Spark's unpenalised multinomial fit; standard errors from the information
    matrix, whose entries are sums over rows in one aggregation.
    """
    classes = levels(df, dependent)
    terms = design(df, independents, transformations)
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), column(dependent).cast("string")) - 1
    names = [f"x{i}" for i in range(len(terms))]
    rows = df.select(*[t.expr.alias(n) for t, n in zip(terms, names, strict=True)], y.cast("double").alias("label")).na.drop("any")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    model = LogisticRegression(family="multinomial", maxIter=200, tol=1e-9).fit(data)
    w = np.column_stack([model.coefficientMatrix.toArray(), np.array(model.interceptVector)])
    w = (w - w[0])[1:]
    x = [*[F.col(n) for n in names], F.lit(1.0)]
    score = [sum((float(c) * v for c, v in zip(row, x, strict=True)), F.lit(0.0)) for row in w]
    top = F.greatest(F.lit(0.0), *score) if len(score) else F.lit(0.0)
    each = [F.exp(-top), *[F.exp(s - top) for s in score]]
    whole = sum(each[1:], each[0])
    p = [e / whole for e in each]
    probs = rows.select(*names, "label", *[q.alias(f"p{i}") for i, q in enumerate(p)])
    k = len(x)
    size = k * len(w)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    info = [F.sum((F.col(f"p{i // k + 1}") * ((1.0 if i // k == j // k else 0.0) - F.col(f"p{j // k + 1}"))) * x[i % k] * x[j % k]).alias(f"h{i}_{j}") for i, j in cells]
    own = F.element_at(F.array(*[F.col(f"p{i}") for i in range(len(classes))]), F.col("label").cast("int") + 1)
    got = probs.agg(F.count("*").alias("n"), F.sum(F.log(own)).alias("llf"), *info).first()
    h = np.zeros((size, size))
    for i, j in cells:
        h[i, j] = h[j, i] = got[f"h{i}_{j}"]
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h, hermitian=True)), 0)).reshape(len(w), k)
    table = []
    for c, coef, err in zip(classes[1:], w, se, strict=True):
        for label, b, e in zip([*(t.label for t in terms), "intercept"], coef, err, strict=True):
            z = float(b / e) if e else math.nan
            table.append((c, label, float(b), float(e), z, 2 * dist.normal_sf(abs(z)) if z == z else math.nan))
    n, llf = got["n"], got["llf"]
    llnull = sum(r["c"] * math.log(r["c"] / n) for r in rows.groupBy("label").agg(F.count("*").alias("c")).collect())
    return table, {"n": n, "llf": llf, "llnull": llnull, "r2": 1 - llf / llnull, "llr_p": dist.chi2_sf(2 * (llf - llnull), size - len(w)), "aic": 2 * size - 2 * llf, "bic": math.log(n) * size - 2 * llf}


def predictions(df: DataFrame, dependent: str, independents: Sequence[str]) -> DataFrame:
    """(actual, predicted, residual) of each complete row under the linear model of all independents."""
    terms = design(df, independents)
    fit = solve(gram(df, column(dependent), terms))
    (_, b0, *_), *rest = fit.rows
    fitted = sum((float(r[1]) * t.expr for r, t in zip(rest, terms, strict=True)), F.lit(float(b0)))
    rows = df.select(column(dependent).cast("double").alias("actual"), fitted.alias("predicted")).na.drop("any")
    return rows.withColumn("residual", F.col("actual") - F.col("predicted"))


def residuals(df: DataFrame, dependent: str, independents: Sequence[str]) -> DataFrame:
    """(residual) of each complete row."""
    return predictions(df, dependent, independents).select("residual")


RESIDUAL_TESTS = ("chisquare", "ks_2samp", "ttest_1samp", "wilcoxon", "normaltest")


def residual_tests(df: DataFrame, dependent: str, independents: Sequence[str], tests: Sequence[str] = RESIDUAL_TESTS) -> dict[str, tuple[float | None, float | None]]:
    """(statistic, p) of tests on a linear model, all or those asked for: predicted against actual values by
    chi-square (rows with an actual value of 0 have no term) and by the distance of their distributions; residuals by
    t and signed ranks against 0, and their normal shape."""
    from gneiss.profile.describe import normality_moments
    from gneiss.stats import comparison

    p = predictions(df, dependent, independents)
    r = p.select("residual", F.lit(0.0).alias("zero"))
    out: dict[str, tuple[float | None, float | None]] = {}
    for test in tests:
        if test == "chisquare":
            chi = comparison.divergence(p.where("actual != 0").select(F.col("predicted").alias("o"), F.col("actual").alias("e"))).first()
            out[test] = (chi["statistic"], comparison.power_divergence_p(chi) if (chi["statistic"] or -1) >= 0 else None)
        elif test == "ks_2samp":
            ks = comparison.ks_2samp(comparison.columns_as_samples(p, ["predicted", "actual"])).first()
            out[test] = (ks["d"], comparison.ks_p(ks)) if ks else (None, None)
        elif test == "ttest_1samp":
            out[test] = comparison.ttest_one(r, "residual")[:2]
        elif test == "wilcoxon":
            w = comparison.wilcoxon(r, "residual", "zero").first()
            out[test] = (w["w"], comparison.wilcoxon_p(w))
        elif test == "normaltest":
            m = normality_moments(r, "residual").first()
            out[test] = (m["skew"], dist.dagostino(m["n"], m["skew"], m["kurt"]) if m["n"] >= 8 and m["skew"] is not None else None)
        else:
            raise ValueError(f"unknown test {test!r}")
    return out


def forward_r2(g: Gram, limit: int = MODEL_LIMIT, gain: float = LEAST_GAIN) -> list[str]:
    """Variables in the order that raises adjusted R2 most, until a step adds under a tenth."""
    variables = list(dict.fromkeys(t.variable for t in g.terms))
    chosen: list[str] = []
    best = 0.0
    while len(chosen) < min(limit, len(variables)):
        score = {v: solve(g, [i for i, t in enumerate(g.terms) if t.variable in (*chosen, v)]).adj_r2 for v in variables if v not in chosen}
        v = max(score, key=lambda x: (score[x], x))
        if chosen and score[v] - best < gain * best:
            break
        chosen.append(v)
        best = score[v]
    return chosen


def f_regression(g: Gram) -> list[tuple[str, float, float]]:
    """(term, F, p) of each term alone."""
    out = []
    for i, t in enumerate(g.terms):
        f = solve(g, [i])
        out.append((t.label, f.f if f.f is not None else math.inf, f.f_p if f.f_p is not None else 0.0))
    return out


def backward_elimination(g: Gram, keep: int) -> list[str]:
    """Terms left after dropping the one of least |t| again and again."""
    left = list(range(len(g.terms)))
    while len(left) > keep:
        rows = solve(g, left).rows[1:]
        left.pop(min(range(len(left)), key=lambda i: abs(rows[i][3]) if rows[i][3] == rows[i][3] else 0.0))
    return [g.terms[i].label for i in left]


def lasso(df: DataFrame, dependent: str, independents: Sequence[str], strength: float = 0.1) -> list[str]:
    """Variables with a nonzero lasso coefficient, strength in standard deviations of the dependent."""
    terms = design(df, independents)
    rows = df.select(*[t.expr.alias(f"x{i}") for i, t in enumerate(terms)], column(dependent).cast("double").alias("label")).na.drop("any")
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(terms))], outputCol="features").transform(rows).select("features", "label")
    sd = rows.agg(F.stddev_pop("label")).first()[0] or 1.0
    model = LinearRegression(elasticNetParam=1.0, regParam=strength * sd, standardization=True).fit(data)
    return list(dict.fromkeys(t.variable for t, c in zip(terms, model.coefficients, strict=True) if c))


def recommend_model(df: DataFrame, dependent: str, candidates: Sequence[str], kind: str = "forwardR2", max_levels: int = 20) -> list[str]:
    """Independents for a dependent, categories of over max_levels left out."""
    fields = [f for f in candidates if f != dependent and not (is_categorical(df, f) and df.select(F.countDistinct(column(f))).first()[0] > max_levels)]
    if kind == "lasso":
        return lasso(df, dependent, fields)
    g = gram(df, column(dependent), design(df, fields))
    by_label = {t.label: t.variable for t in g.terms}
    if kind == "forwardR2":
        return forward_r2(g)
    if kind == "rfe":
        return list(dict.fromkeys(by_label[x] for x in backward_elimination(g, MODEL_LIMIT)))
    if kind == "forwardF":
        return list(dict.fromkeys(by_label[x] for x, _, p in sorted(f_regression(g), key=lambda r: (-r[1], r[0])) if p < 0.05))[:MODEL_LIMIT]
    raise ValueError(f"unknown recommendation {kind!r}")


BASIS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, **{f"x^{k}": (lambda x, k=k: F.pow(x, F.lit(k))) for k in range(1, 9)}}


def auto_fit(df: DataFrame, x: str, y: str, functions: Sequence[str] = tuple(BASIS), threshold: float = 0.9, most: int = 3) -> tuple[list[str], Fit]:
    """The smallest set of basis functions whose R2 exceeds the threshold, or else the best of `most`."""
    v = column(x).cast("double")
    g = gram(df, column(y), [Term(f, f, BASIS[f](v)) for f in functions])
    best: tuple[list[str], Fit] | None = None
    for size in range(1, min(most, len(functions)) + 1):
        fits = [([functions[i] for i in c], solve(g, list(c))) for c in combinations(range(len(functions)), size)]
        best = max(fits, key=lambda f: f[1].r2)
        if best[1].r2 > threshold:
            break
    return best


def all_subsets(g: Gram) -> list[tuple[list[str], Fit]]:
    """Every non-empty set of variables."""
    variables = list(dict.fromkeys(t.variable for t in g.terms))
    sets = reduce(lambda a, n: a + list(combinations(variables, n)), range(1, len(variables) + 1), [])
    return [(list(s), solve(g, [i for i, t in enumerate(g.terms) if t.variable in s])) for s in sets]


def equation(names: Sequence[str], fit: Fit) -> str:
    c = dict((r[0], r[1]) for r in fit.rows)
    return " + ".join([f"{c['intercept']:.4g}", *(f"{c[n]:.4g}*{n}" for n in names)])
