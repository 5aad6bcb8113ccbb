"""Group comparisons. Moments and rank sums come from Spark, tails from dist."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.predicates import column
from gneiss.operators.ranges import quantiles, with_sums_before
from gneiss.profile.describe import normality_moments
from gneiss.stats import dist

MAX_GROUPS = 15
MAX_PAIRED = 1000
NORMAL_P = EQUAL_VARIANCE_P = 0.25


def long_samples(df: DataFrame, group: str, field: str) -> DataFrame:
    return df.na.drop("any", subset=[group, field]).select(column(group).cast("string").alias("g"), column(field).cast("double").alias("x"))


def columns_as_samples(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Several columns as samples (g, x), nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("g"), column(f).cast("double").alias("x")) for f in fields]))
    return df.select(pairs.alias("s")).select("s.*").where("x is not null")


def moments(samples: DataFrame) -> DataFrame:
    return samples.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def few_groups(samples: DataFrame) -> DataFrame:
    """Moments of the groups, for work on pairs of them; an error for more than MAX_PAIRED."""
    m = moments(samples)
    if m.limit(MAX_PAIRED + 1).count() > MAX_PAIRED:
        raise ValueError(f"over {MAX_PAIRED} groups to compare in pairs")
    return m


def f_table(m: DataFrame) -> DataFrame:
    """One-way analysis of variance from group moments: df, sums of squares and F."""
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    total = m.agg(grand.alias("grand"))
    parts = m.join(F.broadcast(total)).agg(  # one row
        (F.count("*") - 1).alias("df_between"),
        (F.sum("n") - F.count("*")).alias("df_within"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"),
    )
    f = F.try_divide(F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within"))
    return parts.withColumn("f", f)


def with_p(row) -> tuple[float | None, float | None]:
    f = row["f"]
    return f, None if f is None else dist.f_sf(f, row["df_between"], row["df_within"])


def anova_oneway(df: DataFrame, group: str, field: str) -> DataFrame:
    return f_table(moments(long_samples(df, group, field)))


def levene(samples: DataFrame) -> DataFrame:
    """F over distances from the group medians (Brown and Forsythe)."""
    centre = quantiles(samples, "x", (0.5,), ["g"]).toDF("g", "m")
    away = samples.join(centre, "g").select("g", F.abs(F.col("x") - F.col("m")).alias("x"))
    return f_table(moments(away))


def value_ranks(samples: DataFrame) -> DataFrame:
    """(x, g, n, ties, rank): average ranks by distinct value. Values are counted first and put in order range by range."""
    per = samples.groupBy("x", "g").agg(F.count("*").alias("n"))
    ties = with_sums_before(per.groupBy("x").agg(F.sum("n").alias("ties")), ["x"], {"base": F.col("ties")})
    ranks = ties.select("x", "ties", (F.col("base") + (F.col("ties") + 1) / 2.0).alias("rank"))
    return per.join(ranks, "x")


def tie_term() -> Column:
    """Over value_ranks: the sum of t^3 - t over values of t ties, each value's share dealt out to its samples' n."""
    t = F.col("ties").cast("double")
    return F.sum(F.col("n") * (t * t - 1))


def kruskal(samples: DataFrame) -> DataFrame:
    """H corrected for ties, with the number of samples and of values."""
    r = value_ranks(samples)
    sums = r.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"), tie_term().alias("tied"))
    one = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("tied").alias("tied"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("tied") / (n * n * n - n))
    return one.select("k", "n", h.alias("h"))


def mann_whitney(samples: DataFrame) -> DataFrame:
    """U of the first sample by name, the sizes and the tie term."""
    r = value_ranks(samples)
    sums = r.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"), tie_term().alias("tied"))
    first, last = F.min_by("n", "g"), F.max_by("n", "g")
    u = F.min_by("r", "g") - first * (first + 1) / 2.0
    return sums.agg(first.alias("n1"), last.alias("n2"), u.alias("u"), F.sum("tied").alias("tied"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of two columns of one row, equal ones left out: pairs, both rank sums, the statistic and the tie term."""
    d = (column(a).cast("double") - column(b).cast("double")).alias("d")
    signed = df.na.drop("any", subset=[a, b]).select(d).where("d != 0").select(F.when(F.col("d") > 0, "plus").otherwise("minus").alias("g"), F.abs("d").alias("x"))
    r = value_ranks(signed)
    part = lambda g: F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n") * F.col("rank"))), F.lit(0.0))
    one = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), part("plus").alias("plus"), part("minus").alias("minus"), F.coalesce(tie_term(), F.lit(0.0)).alias("tied"))
    return one.select("n", "plus", "minus", F.least("plus", "minus").alias("w"), "tied")


def wilcoxon_p(row) -> float | None:
    n = row["n"]
    var = n * (n + 1) * (2 * n + 1) / 24 - row["tied"] / 48
    return min(1.0, 2 * dist.normal_sf((n * (n + 1) / 4 - row["w"]) / math.sqrt(var))) if n and var > 0 else None


def friedman(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Friedman's chi-square over several columns of one row, corrected for ties; ranks are made inside each row."""
    xs = [column(f).cast("double") for f in fields]
    k = len(fields)
    ranks = [sum(((y < x).cast("double") for y in xs), F.lit(0.5)) + sum(((y == x).cast("double") for y in xs), F.lit(0.0)) / 2 for x in xs]
    ties = sum((sum(((y == x).cast("double") for y in xs), F.lit(0.0)) for x in xs), F.lit(0.0))
    square = sum(((sum(((y == x).cast("double") for y in xs), F.lit(0.0)) * sum(((y == x).cast("double") for y in xs), F.lit(0.0))) for x in xs), F.lit(0.0)) - float(k)
    rows = df.na.drop("any", subset=list(fields)).select(*[r.alias(f"r{i}") for i, r in enumerate(ranks)], square.alias("t"), ties.alias("e"))
    one = rows.agg(F.count("*").alias("n"), F.sum("t").alias("t"), *[F.sum(f"r{i}").alias(f"s{i}") for i in range(k)])
    n = F.col("n").cast("double")
    total = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    chi2 = F.try_divide(12 / (n * k * (k + 1)) * total - 3 * n * (k + 1), 1 - F.col("t") / (n * k * (k * k - 1)))
    return one.select("n", F.lit(k).alias("k"), chi2.alias("chi2"))


def chi_square(df: DataFrame, field: str) -> DataFrame:
    """Chi-square of a field's frequencies against equal ones."""
    per = df.where(column(field).isNotNull()).groupBy(column(field)).agg(F.count("*").cast("double").alias("o"))
    mean = F.sum("o") / F.count("*")
    return per.agg(F.count("*").alias("k"), (F.sum(F.col("o") * F.col("o")) / mean - F.sum("o")).alias("chi2"))


POWERS = {"pearson": 1.0, "log-likelihood": 0.0, "freeman-tukey": -0.5, "mod-log-likelihood": -1.0, "neyman": -2.0, "cressie-read": 2 / 3}


def divergence(cells: DataFrame, power: str | float = "pearson") -> DataFrame:
    """The power divergence of observed counts o from expected ones e, and the number of cells.

    Pearson's chi-square is the power 1, the likelihood ratio the power 0. Cells without a value on either side go;
    an empty cell adds what the limit of its term is, and nothing is returned where that is infinite.
    """
    k = POWERS[power] if isinstance(power, str) else float(power)
    o, e = F.col("o").cast("double"), F.col("e").cast("double")
    if k == 1:
        term = (o - e) * (o - e) / e
    elif k == 0:
        term = 2 * F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    elif k == -1:
        term = 2 * F.when(e > 0, e * F.log(e / o)).otherwise(0.0)
    else:
        term = F.when((o == 0) & (F.lit(k) > 0), 0.0).otherwise(2 / (k * (k + 1)) * o * (F.pow(o / e, F.lit(k)) - 1))
    return cells.where("o is not null and e is not null").agg(F.count("*").alias("k"), F.sum(term).alias("statistic"))


def power_divergence(df: DataFrame, field: str, power: str | float = "pearson", expected: Mapping | None = None) -> DataFrame:
    """The divergence of a field's frequencies from equal ones, or from the given share of each value."""
    per = df.where(column(field).isNotNull()).groupBy(column(field).alias("v")).agg(F.count("*").cast("double").alias("o"))
    if expected is None:
        cells = per.crossJoin(F.broadcast(per.agg(F.avg("o").alias("e"))))  # one row
    else:
        total = sum(expected.values())
        shares = df.sparkSession.createDataFrame([(v, float(s) / total) for v, s in expected.items()], f"v {df.schema[field].dataType.simpleString()}, share double")
        n = per.agg(F.sum("o").alias("n"))
        cells = shares.join(per, "v", "left").crossJoin(F.broadcast(n)).select(F.coalesce("o", F.lit(0.0)).alias("o"), (F.col("share") * F.col("n")).alias("e"))  # one row
    return divergence(cells, power)


def power_divergence_p(row, less: int = 0) -> float | None:
    return dist.chi2_sf(row["statistic"], row["k"] - 1 - less) if row["statistic"] is not None and row["k"] > 1 + less else None


def _normal(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """The normal distribution function, which Spark lacks, batch by batch."""

    def cdf(z: pa.Array) -> pa.Array:
        return pa.array([None if v is None else 0.5 * math.erfc(-v / math.sqrt(2)) for v in z.to_pylist()], pa.float64())

    return F.arrow_udf(cdf, "double")((x - mean) / sd)


CDFS = {
    "norm": _normal,
    "uniform": lambda x, low=0.0, width=1.0: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / width)),
    "expon": lambda x, low=0.0, scale=1.0: F.when(x <= low, 0.0).otherwise(1 - F.exp(-(x - low) / scale)),
}


def kstest(df: DataFrame, field: str, cdf: str | Callable[[Column], Column] = "norm", args: Sequence[float] = ()) -> DataFrame:
    """Values and the largest distance of a field's distribution function from a given one, range by range over distinct values."""
    x = column(field).cast("double")
    per = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("c"))
    run = with_sums_before(per, ["x"], {"before": F.col("c")})
    f = CDFS[cdf](F.col("x"), *args) if isinstance(cdf, str) else cdf(F.col("x"))
    at = run.select("c", "before", f.alias("f"))
    n = per.agg(F.sum("c").alias("n"))
    far = F.greatest((F.col("before") + F.col("c")) / F.col("n") - F.col("f"), F.col("f") - F.col("before") / F.col("n"))
    return at.crossJoin(F.broadcast(n)).groupBy("n").agg(F.max(far).alias("d"))  # one row


def kstest_p(row) -> float:
    root = math.sqrt(row["n"])
    return dist.kolmogorov_sf((root + 0.12 + 0.11 / root) * row["d"])


def ttest_one(df: DataFrame, field: str, mean: float = 0.0) -> tuple[float | None, float | None, int]:
    """T, p and degrees of freedom of one column against a mean."""
    x = column(field).cast("double")
    m = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if m["n"] < 2 or not m["s"]:
        return None, None, max(m["n"] - 1, 0)
    t = (m["m"] - mean) / (m["s"] / math.sqrt(m["n"]))
    return t, dist.t_sf2(t, m["n"] - 1), m["n"] - 1


def mann_whitney_p(row, alternative: str = "one-sided") -> float:
    n1, n2, n = row["n1"], row["n2"], row["n1"] + row["n2"]
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - row["tied"] / (n * (n - 1))))
    u = max(row["u"], n1 * n2 - row["u"])
    p = dist.normal_sf((u - 0.5 - n1 * n2 / 2) / sd)
    return p if alternative == "one-sided" else min(1.0, 2 * p)


def ks_2samp(samples: DataFrame) -> DataFrame:
    """Largest distance of two samples' distribution functions, over distinct values."""
    first = samples.agg(F.min("g").alias("first"))
    sides = samples.join(F.broadcast(first)).select("x", (F.col("g") == F.col("first")).alias("own"))  # one row
    counts = lambda a, b: (F.count_if("own").alias(a), F.count_if(~F.col("own")).alias(b))
    run = with_sums_before(sides.groupBy("x").agg(*counts("a", "b")), ["x"], {"pa": F.col("a"), "pb": F.col("b")}).select((F.col("pa") + F.col("a")).alias("ca"), (F.col("pb") + F.col("b")).alias("cb"))
    n = sides.agg(*counts("n1", "n2"))
    return run.join(F.broadcast(n)).groupBy("n1", "n2").agg(F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("d"))  # one row


def ks_p(row) -> float:
    ne = math.sqrt(row["n1"] * row["n2"] / (row["n1"] + row["n2"]))
    return dist.kolmogorov_sf((ne + 0.12 + 0.11 / ne) * row["d"])


def ttest_pairs(samples: DataFrame) -> DataFrame:
    """Pooled two-sample t for each pair of groups, MAX_PAIRED groups at most."""
    m = few_groups(samples)
    other = m.select(*[F.col(c).alias(f"{c}_b") for c in m.columns])
    pooled = ((F.col("n") - 1) * F.col("var") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n") + F.col("n_b") - 2)
    t = (F.col("mean") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("n_b")))
    return m.join(other, F.col("g") < F.col("g_b")).select(F.col("g").alias("a"), F.col("g_b").alias("b"), (F.col("n") + F.col("n_b") - 2).alias("df"), t.alias("t"))  # groups, not rows


def ttest_paired(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """t, p and degrees of freedom of two columns of one row."""
    d = column(a).cast("double") - column(b).cast("double")
    m = df.na.drop("any", subset=[a, b]).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    t = m["m"] / (m["s"] / math.sqrt(m["n"]))
    return t, dist.t_sf2(t, m["n"] - 1), m["n"] - 1


def tukey_pairs(samples: DataFrame) -> DataFrame:
    """Differences of group means, b - a, and their standard errors, for MAX_PAIRED groups at most."""
    m = few_groups(samples)
    mse = m.agg((F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))) / (F.sum("n") - F.count("*"))).alias("mse"), (F.sum("n") - F.count("*")).alias("df"), F.count("*").alias("k"))
    other = m.select(*[F.col(c).alias(f"{c}_b") for c in m.columns])
    pairs = m.join(other, F.col("g") < F.col("g_b")).join(F.broadcast(mse))  # groups, not rows
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("n") + 1 / F.col("n_b")))
    return pairs.select(F.col("g").alias("a"), F.col("g_b").alias("b"), (F.col("mean_b") - F.col("mean")).alias("diff"), se.alias("se"), "df", "k")


def tukey(samples: DataFrame, alpha: float = 0.05) -> list[dict]:
    out = []
    for r in tukey_pairs(samples).orderBy("a", "b").collect() if samples.select("g").distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else []:
        p = dist.studentized_range_sf(abs(r["diff"]) / r["se"], r["k"], r["df"])
        q = dist.bisect(lambda x, r=r: dist.studentized_range_sf(x, r["k"], r["df"]), alpha, 0.0, 10.0)
        out.append({"a": r["a"], "b": r["b"], "diff": r["diff"], "low": r["diff"] - q * r["se"], "high": r["diff"] + q * r["se"], "p": p, "distinct": p < alpha})
    return out


def sets_normal(df: DataFrame, fields: Sequence[str]) -> bool:
    rows = [normality_moments(df, f).first() for f in fields]
    return all(r["n"] >= 8 and r["skew"] is not None and dist.dagostino(r["n"], r["skew"], r["kurt"]) >= NORMAL_P for r in rows)


def valid_tests(samples: int, normal: bool, equal_variance: bool, independent: bool = True) -> list[str]:
    """H6: which tests a number of samples and their shape allow."""
    if samples == 1:
        return ["chisquare", "power_divergence", "kstest"] + (["ttest_1samp"] if normal else [])
    if samples == 2:
        tests = ["mannwhitneyu", "kruskal", "ks_2samp"] if independent else ["wilcoxon"]
        if normal:
            tests.append("ttest_ind" if independent else "ttest_rel")
        return tests + (["f_oneway"] if normal and equal_variance and independent else [])
    if samples > 2:
        return (["kruskal"] if independent else ["friedmanchisquare"]) + (["f_oneway"] if normal and equal_variance and independent else [])
    return []


def compare_columns(df: DataFrame, fields: Sequence[str], independent: bool = True) -> dict[str, tuple[float, float]]:
    """(statistic, p) of every test that suits the columns; independent: whether they are separate samples or measured on the same rows."""
    samples = columns_as_samples(df, fields)
    _, equal_p = with_p(levene(samples).first())
    out: dict[str, tuple[float, float]] = {}
    for test in valid_tests(len(fields), sets_normal(df, fields), (equal_p or 0) > EQUAL_VARIANCE_P, independent):
        if test == "mannwhitneyu":
            r = mann_whitney(samples).first()
            out[test] = (min(r["u"], r["n1"] * r["n2"] - r["u"]), mann_whitney_p(r))
        elif test == "kruskal":
            r = kruskal(samples).first()
            out[test] = (r["h"], dist.chi2_sf(r["h"], r["k"] - 1))
        elif test == "ks_2samp":
            r = ks_2samp(samples).first()
            out[test] = (r["d"], ks_p(r))
        elif test == "ttest_ind":
            r = ttest_pairs(samples).first()
            out[test] = (r["t"], dist.t_sf2(r["t"], r["df"]))
        elif test == "wilcoxon":
            r = wilcoxon(df, *fields).first()
            out[test] = (r["w"], wilcoxon_p(r))
        elif test == "friedmanchisquare":
            r = friedman(df, fields).first()
            out[test] = (r["chi2"], dist.chi2_sf(r["chi2"], r["k"] - 1))
        elif test == "ttest_rel":
            out[test] = ttest_paired(df, *fields)[:2]
        elif test == "f_oneway":
            out[test] = with_p(f_table(moments(samples)).first())
    return out


def test_column(df: DataFrame, field: str, power: str | float = "log-likelihood", mean: float = 0.0) -> dict[str, tuple[float | None, float | None]]:
    """(statistic, p) of every test that suits one column: its frequencies against equal ones, its values against the standard normal distribution, its mean."""
    out: dict[str, tuple[float | None, float | None]] = {}
    for test in valid_tests(1, sets_normal(df, [field]), False):
        if test in ("chisquare", "power_divergence"):
            r = power_divergence(df, field, "pearson" if test == "chisquare" else power).first()
            out[test] = (r["statistic"], power_divergence_p(r))
        elif test == "kstest":
            r = kstest(df, field).first()
            out[test] = (r["d"], kstest_p(r)) if r else (None, None)
        else:
            out[test] = ttest_one(df, field, mean)[:2]
    return out


def comparison_kind(dependents: Sequence[str], independents: Sequence[str]) -> str | None:
    """H1: anova with both sides, numeric with two or more fields on one side alone."""
    if dependents and independents:
        return "anova"
    return "numeric" if len(dependents) >= 2 or len(independents) >= 2 else None


def pairs_of(groups: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(groups, 2))
