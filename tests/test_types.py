"""Free-form dates, numbers of other locales, sketches of fields, one-sample tests: against Python."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gneiss.profile import infer, relations
from gneiss.sources.readers import coerce
from gneiss.stats import comparison, dist, regression

DATES = {
    "3rd of May 2019": (2019, 5, 3),
    "May 3, 2019": (2019, 5, 3),
    "Friday, May 3rd, 2019": (2019, 5, 3),
    "fri 3 may 2019 14:05": (2019, 5, 3, 14, 5),
    "May 3, 2019 at 4:05 pm": (2019, 5, 3, 16, 5),
    "12:30 pm": None,
    "December 12 2019 12:00 AM": (2019, 12, 12),
    "21st September 1999 23:59:58": (1999, 9, 21, 23, 59, 58),
    "2019 Jan 31": (2019, 1, 31),
    "2019-Feb-28": (2019, 2, 28),
    "3-Aug-19": (2019, 8, 3),
    "3 Aug '71": (1971, 8, 3),
    "Sept. 2019": (2019, 9, 1),
    "31 February 2019": None,
    "May 12": None,
    "mayor 2019": None,
    "March of the penguins 2": None,
    "13:00 pm May 3 2019": None,
    "2019-05-03": (2019, 5, 3),
    "2019-05-03 04:05:06": (2019, 5, 3, 4, 5, 6),
    "3/5/2019": (2019, 5, 3),
    "hello": None,
    "": None,
    None: None,
}
NUMBERS = {"1.234,56": 1234.56, "-12.345.678": -12345678.0, "1 234,56": 1234.56, "1 234 567": 1234567.0, "1'234.5": 1234.5, "1,234.5": 1234.5, "1,234": 1234.0, "1.234": 1.234, "12": 12.0, "1.23,4": 1.234, "1 23": None, "a": None, "1e3": 1000.0, None: None}


def test_free_dates(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(d,) for d in DATES], "s string").select("s", infer.parsed_time(F.col("s"))).collect()}
    assert got == {s: d and datetime.datetime(*d) for s, d in DATES.items()}
    dates = [s for s, d in DATES.items() if d]
    assert infer.infer_types(spark.createDataFrame([(d,) for d in dates], "s string"))[0].type == "datetime"


def test_numbers_of_other_locales(spark):
    df = spark.createDataFrame([(d,) for d in NUMBERS], "s string")
    assert {r[0]: r[1] for r in df.select("s", infer.number(F.col("s"))).collect()} == NUMBERS
    eu = spark.createDataFrame([("1.234,56",), ("2.000,00",), ("12.345,5",)], "s string")
    assert infer.infer_types(eu)[0].type == "decimal"
    assert sorted(r[0] for r in coerce(eu, {"s": "decimal"}).collect()) == [1234.56, 2000.0, 12345.5]


def test_join_discovery_equals_all_pairs(spark):
    rng = random.Random(9)
    base = [str(i) for i in range(400)]
    sets = {("a", "x"): base, ("b", "y"): base[:330], ("b", "z"): [*base[:320], *(f"n{i}" for i in range(100))], ("c", "w"): base[80:], ("c", "v"): [f"q{i}" for i in range(300)], ("d", "u"): [*base, None, None]}
    tables = {}
    for t in "abcd":
        fields = [f for s, f in sets if s == t]
        size = max(len(sets[t, f]) for f in fields) * 2
        rows = [tuple(sets[t, f][i] if i < len(sets[t, f]) else rng.choice(sets[t, f]) for f in fields) for i in range(size)]
        tables[t] = (spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)), fields)
    want = {}
    for (s, f), x in sets.items():
        for (t, g), y in sets.items():
            x1, y1 = set(x) - {None}, set(y) - {None}
            if s < t and len(x1 & y1) >= 0.8 * len(x1 | y1):
                want[s, f, t, g] = (len(x1 & y1) / len(x1 | y1), "11" if len(x1) == len(y1) else "N1" if len(x1) > len(y1) else "1N")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in relations.discover_joins(tables).collect()}
    assert got == want and len(want) >= 4
    likely = relations.likely_pairs(tables)
    assert set(want) <= set(likely) and all(("c", "v") not in (p[:2], p[2:]) for p in likely)  # unlike fields are never joined
    assert relations.discover_joins({"c": tables["c"]}).count() == 0


def test_sketch_bound_is_a_binomial_tail():
    need = relations.least_matches(96, 0.8, 1e-9)
    tail = lambda m: sum(math.comb(96, k) * 0.8**k * 0.2 ** (96 - k) for k in range(m))
    assert tail(need) <= 1e-9 < tail(need + 1)


def test_power_divergence(spark):
    o = {"a": 30, "b": 14, "c": 34, "d": 45, "e": 57, "f": 20}
    df = spark.createDataFrame([(v,) for v, n in o.items() for _ in range(n)] + [(None,)], "v string")
    n, k = sum(o.values()), len(o)
    e = n / k
    want = {
        "pearson": sum((x - e) ** 2 / e for x in o.values()),
        "log-likelihood": 2 * sum(x * math.log(x / e) for x in o.values()),
        "mod-log-likelihood": 2 * sum(e * math.log(e / x) for x in o.values()),
        "neyman": sum((x - e) ** 2 / x for x in o.values()),
        "freeman-tukey": 4 * sum((math.sqrt(x) - math.sqrt(e)) ** 2 for x in o.values()),
        "cressie-read": 9 / 5 * sum(x * ((x / e) ** (2 / 3) - 1) for x in o.values()),
    }
    for power, value in want.items():
        r = comparison.power_divergence(df, "v", power).first()
        assert (r["k"], r["statistic"]) == (k, pytest.approx(value)), power
    shares = {"a": 1, "b": 1, "c": 2, "d": 2, "e": 2, "f": 1, "g": 1}
    r = comparison.power_divergence(df, "v", "log-likelihood", shares).first()
    assert r["k"] == 7 and r["statistic"] == pytest.approx(2 * sum(x * math.log(x / (n * shares[v] / 10)) for v, x in o.items()))
    assert comparison.power_divergence_p(r) == pytest.approx(dist.chi2_sf(r["statistic"], 6))


def plain_ks(values, cdf):
    x, n = sorted(values), len(values)
    return max(max((i + 1) / n - cdf(v), cdf(v) - i / n) for i, v in enumerate(x))


def test_kstest(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0.1, 1), 2) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    normal = statistics.NormalDist()
    assert comparison.kstest(df, "x").first()["d"] == pytest.approx(plain_ks(values, normal.cdf))
    assert comparison.kstest(df, "x", "norm", (0.1, 2.0)).first()["d"] == pytest.approx(plain_ks(values, statistics.NormalDist(0.1, 2).cdf))
    assert comparison.kstest(df, "x", "uniform", (-3.0, 6.0)).first()["d"] == pytest.approx(plain_ks(values, lambda v: min(1, max(0, (v + 3) / 6))))
    assert comparison.kstest(df, "x", "expon").first()["d"] == pytest.approx(plain_ks(values, lambda v: 0.0 if v <= 0 else 1 - math.exp(-v)))
    assert comparison.kstest(df, "x", lambda c: F.when(c < 0, 0.0).otherwise(1.0)).first()["d"] == pytest.approx(plain_ks(values, lambda v: float(v >= 0)))
    assert 0 <= comparison.kstest_p(comparison.kstest(df, "x").first()) <= 1
    assert comparison.kstest(df.where("x is null"), "x").count() == 0
    tests = comparison.test_column(df, "x")
    assert {"chisquare", "power_divergence", "kstest"} <= set(tests)


def test_residual_tests_hold_predictions_against_actual_values(spark):
    rng = random.Random(6)
    rows = [(float(i % 20), 5 + 2 * (i % 20) + rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = regression.residual_tests(df, "y", ["x"])
    p = regression.predictions(df, "y", ["x"]).collect()
    assert got["chisquare"][0] == pytest.approx(sum((r["predicted"] - r["actual"]) ** 2 / r["actual"] for r in p))
    a, b = sorted(round(r["actual"], 12) for r in p), sorted(round(r["predicted"], 12) for r in p)
    far = max(abs(sum(v <= x for v in a) - sum(v <= x for v in b)) / len(p) for x in {*a, *b})
    assert got["ks_2samp"][0] == pytest.approx(far, abs=0.01) and got["ttest_1samp"][1] > 0.9
