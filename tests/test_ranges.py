"""Order by ranges, quantiles, medians and modes on hot keys, against sorting in Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gneiss.operators import binning, groupings, ranges
from gneiss.stats import comparison, regression


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 50)


@pytest.fixture(scope="module")
def hot(spark):
    """6,000 rows on 12 keys, a third of them on one, with two groups and some equal rows."""
    rng = random.Random(4)
    rows = [(rng.choice([5, 5, 5, 5, *range(8)]), rng.randint(0, 3000), rng.choice("ab")) for _ in range(5000)] + [(5, 1, "a")] * 1000
    return spark.createDataFrame(rows, "k int, v int, g string").repartition(4), rows


def codegen(df):
    return df._jdf.queryExecution().toString()


def test_hot_keys_fill_many_ranges(hot, tiny):
    df, rows = hot
    per = ranges.placed(df.distinct(), ["k"]).groupBy("part").count().collect()
    n = len(set(rows))
    assert len(per) > 0.7 * (n // 50) and max(r["count"] for r in per) < 50 * 6


def test_binary_search_counts_the_bounds_at_or_below(spark):
    for n in (1, 2, 3, 7, 8, 20):
        bounds = [F.lit(3 * i) for i in range(n)]
        got = spark.range(-2, 70).select("id", ranges.bounds_below(bounds, F.col("id")).alias("p")).collect()
        assert all(r["p"] == sum(3 * i <= r["id"] for i in range(n)) for r in got)


def test_indexed_values_number_all_rows_in_order(hot, tiny, monkeypatch):
    df, rows = hot
    for copies in (10**6, 7):
        monkeypatch.setattr(groupings, "COPIES", copies)
        got = sorted(tuple(r) for r in groupings.indexed_values(df, "v", ["k", "g"]).collect())
        assert [i for i, _ in got] == list(range(len(rows)))
        want = sorted((k, g) for k, v, g in rows)
        at = {}
        for i, key in enumerate(want):
            at.setdefault(key, []).append(i)
        for key, places in at.items():
            assert sorted(v for i, v in got[places[0] : places[-1] + 1]) == sorted(v for k, v, g in rows if (k, g) == key)


def test_sums_before_over_repeated_keys(hot, tiny):
    df, rows = hot
    got = ranges.with_sums_before(df, ["k"], {"before": F.col("v")}).orderBy("before", "k", "v").collect()
    run = 0
    for r in sorted(got, key=lambda r: (r["k"], r["before"] + r["v"], r["before"])):
        assert r["before"] == run
        run += r["v"]


@pytest.mark.parametrize("few", [True, False])
def test_medians_and_modes(hot, monkeypatch, few):
    if not few:
        monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 50)
    df, rows = hot
    values = [v for _, v, _ in rows]
    by = {g: [v for _, v, h in rows if h == g] for g in "ab"}
    plans = [
        groupings.single(df, "v", "median"),
        groupings.value_aggregate(df, "g", "v", "median"),
        groupings.scalar_aggregates(df, "v"),
        groupings.single(df, "v", "mode"),
        groupings.fused(df, "g", [("v", "median"), ("v", "sum"), ("k", "median")]),
        groupings.multigroup(df, "g", "k", "v", "median"),
        groupings.aggregate_pairs(df, "g", "v", "k", "median"),
        binning.histogram(df, "v", "v", "median", edges=[0.0, 100.0, 3000.0]),
        groupings.box(df, "g", "v"),
    ]
    text = "".join(codegen(p) for p in plans)
    assert "median(" not in text.replace("median(v)", "").replace("median(k)", "") and "mode(" not in text
    assert plans[0].first()[0] == statistics.median(values)
    assert {r["value"]: r["agg"] for r in plans[1].collect()} == {g: statistics.median(x) for g, x in by.items()}
    one = plans[2].first()
    assert (one["median"], one["sum"], one["count"]) == (statistics.median(values), sum(values), len(values))
    assert plans[3].first()[0] == min(set(values), key=lambda v: (-values.count(v), v))
    assert {r["value"]: (r[1], r[2], r[3]) for r in plans[4].collect()} == {g: (statistics.median(x), sum(x), statistics.median([k for k, _, h in rows if h == g])) for g, x in by.items()}
    assert {(r["a"], r["b"]): r["agg"] for r in plans[5].collect()} == {(g, k): statistics.median([v for j, v, h in rows if (h, j) == (g, k)]) for g, k in {(g, k) for k, _, g in rows}}
    assert {r["value"]: r["agg_a"] for r in plans[6].collect()} == {g: statistics.median(x) for g, x in by.items()}
    assert [r["agg"] for r in plans[7].orderBy("bin").collect()] == [statistics.median([v for v in values if v < 100]), statistics.median([v for v in values if v >= 100])]
    for r in plans[8].collect():
        x = by[r["value"]]
        q1, m, q3 = statistics.quantiles(x, n=4, method="inclusive")
        inside = [v for v in x if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert (r["bottom"], r["q1"], r["median"], r["q3"], r["top"]) == (min(inside), q1, m, q3, max(inside)) and r["mean"] == pytest.approx(sum(x) / len(x))


def test_nothing(spark):
    none = spark.createDataFrame([], "k int, v int, g string")
    assert groupings.single(none, "v", "median").first()[0] is None
    assert groupings.scalar_aggregates(none, "v").first()["median"] is None
    assert groupings.value_aggregate(none, "g", "v", "median").count() == 0
    assert groupings.indexed_values(none, "v", ["k"]).count() == 0


def test_ranges_are_found_by_compiled_steps(hot, tiny):
    """A search by higher-order functions runs interpreted, for each row anew."""
    df, _ = hot
    placed = ranges.placed(df, ["k"])
    assert "lambda" not in codegen(placed)
    keys, part = zip(*sorted((r["k"], r["part"]) for r in placed.collect()), strict=True)
    assert list(part) == sorted(part) and len(set(part)) > 1


def test_ranks_are_made_once(spark):
    """The tie term comes with the rank sums: one window over the values, not two."""
    df = spark.createDataFrame([(g, float(x)) for x, n in ((1, 3), (2, 2), (5, 1), (7, 4)) for g in "abb" for _ in range(n)], "g string, x double")
    tied = sum((3 * n) ** 3 - 3 * n for n in (3, 2, 1, 4))
    assert comparison.mann_whitney(df).first()["tied"] == tied
    for ranked in (comparison.mann_whitney(df), comparison.kruskal(df)):
        assert codegen(ranked).split("== Physical Plan ==")[0].count("Window [") == codegen(comparison.value_ranks(df)).split("== Physical Plan ==")[0].count("Window [") > 0


def test_only_the_residual_tests_asked_for_run(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7 + F.col("id")).cast("double").alias("y"))
    every = regression.residual_tests(df, "y", ["x"])
    assert tuple(every) == regression.RESIDUAL_TESTS
    assert regression.residual_tests(df, "y", ["x"], ["ks_2samp", "chisquare"]) == {k: every[k] for k in ("ks_2samp", "chisquare")}
