"""Edge cases: nulls, ties, constants, empty tables; planner counts; published values of the tails."""

import datetime
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.operators import crosstab, groupings, transform
from gneiss.operators.binning import BinStats, bin_edges, bin_index, histogram, number_of_bins
from gneiss.operators.predicates import filtered
from gneiss.plans.compile import compile_batch, compile_spec
from gneiss.plans.enumerate import enumerate_specs
from gneiss.plans.specs import make
from gneiss.plans.score import dispersion, entropy, gini
from gneiss.profile import describe, infer, relations
from gneiss.profile.describe import Field
from gneiss.session import Engine
from gneiss.sources import readers, sinks
from gneiss.stats import comparison, correlation, dist, regression
from gneiss.streaming.counts import windowed_counts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_predicates_keep_the_precedence(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, `odd name` string")
    both = {"and": [{"field": "x", "operation": ">", "criteria": 1}, {"field": "odd name", "operation": "==", "criteria": "b"}], "or": [{"field": "x", "operation": "==", "criteria": 3}]}
    assert [r.x for r in filtered(df, both).collect()] == [2, 3]
    assert filtered(df, {"and": [{"field": "none", "operation": "==", "criteria": 1}, {"field": "x", "operation": "==", "criteria": None}]}).count() == 3
    with pytest.raises(ValueError):
        filtered(df, {"and": [{"field": "x", "operation": "; drop", "criteria": 1}]})


def test_joins(spark):
    left = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (None, 12, 7)], "id int, v int, w int")
    right = spark.createDataFrame([(1, 20, 8), (2, 21, 9), (None, 22, 1)], "id int, v int, z int")
    out = transform.join(left, right, ["id"], how="outer")
    assert out.columns == ["id", "v_left", "w", "v_right", "z"]
    assert out.count() == 5
    assert transform.join(left, right, ["id"], match_nulls=True).count() == 3
    assert transform.join(left, right, left_on=["w"], right_on=["z"]).columns == ["id_left", "v_left", "w", "id_right", "v_right", "z"]


def test_unpivot_mixed_types(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id int, a int, b string")
    assert rows(transform.unpivot(df, ["a", "b"])) == [(1, "a", "2"), (1, "b", "x")]


def test_groupings_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), ("b", 2.0)], "k string, x double")
    assert rows(groupings.value_counts(df, "k")) == [("a", 2), ("b", 1)]
    (a, b) = sorted(groupings.value_aggregate(df, "k", "x", "mean").collect())
    assert (a.agg, a.lower) == (1.0, None) and b.agg == 2.0
    assert groupings.box(df.limit(0), "k", "x").count() == 0
    assert [r["index"] for r in groupings.indexed_values(df, "x", ["x"]).orderBy("index").collect()] == [0, 1, 2, 3]


def test_bins(spark):
    assert number_of_bins(BinStats(9, 1.0, 1.0, 1.0, 1.0, None, 1, True)) == 1
    assert number_of_bins(BinStats(9, 0.0, 8.0, 4.0, 4.0, 0.0, 3, True)) == 20
    df = spark.createDataFrame([(float(x),) for x in (-3, -2, -1, 0)], "x double")
    assert [r.agg for r in histogram(df, "x", edges=[-3.0, -2.0, 0.0]).orderBy("bin").collect()] == [1, 3]
    assert rows(df.select(bin_index(F.col("x"), [-3.0, -1.0, 0.0], True))) == [(0,), (0,), (0,), (1,)]
    assert bin_edges(BinStats(0, None, None, None, None, None, 0, True), 3) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_histogram_counts_every_value(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert histogram(df, "x").agg(F.sum("agg")).first()[0] == len(xs)


def test_crosstabs(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "r string, c string, v double")
    assert rows(crosstab.crosstab2(df, "r", "c")) == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 0)]
    assert crosstab.crosstab2_totals(df, "r", "c").where("level = 3").first().value == 3
    assert crosstab.run_aggregation(df, ["r", "c", "v"]) is None
    assert crosstab.run_aggregation(df, ["v"]).agg(F.sum("value")).first()[0] == 3


def test_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "yes", "2020-01-02", "Monday", "France", "1,234", "x", None), ("-2", "2", "no", "2021-03-04", "Tuesday", "Spain", "5", "y", None)],
        "ints string, decs string, flags string, dates string, days string, places string, big string, words string, nothing string",
    )
    got = {t.name: t.type for t in infer.infer_types(df)}
    assert got == {"ints": "integer", "decs": "decimal", "flags": "boolean", "dates": "datetime", "days": "day", "places": "countryName", "big": "integer", "words": "string", "nothing": "string"}
    assert infer.settle("year", {"integer": 8.0}).type == "year" and infer.settle("Year built", {"integer": 8.0}).type == "integer"
    out = readers.coerce(df, {"big": "integer", "dates": "datetime", "decs": "decimal", "words": "integer"}).first()
    assert (out.big, out.dates, out.decs, out.words) == (1234, datetime.datetime(2020, 1, 2), 1.5, None)
    assert infer.is_wide_time_series(["country", "2001", "2002", "2003"]) and not infer.is_wide_time_series(["a", "b"])


def test_profile_and_relations(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "state string, city string, n int")
    fields = {f.name: f for f in describe.profile(df)}
    assert fields["n"].scale == "ordinal" and fields["city"].unique
    h = relations.hierarchies(df, ["state", "city"])
    assert h["city"]["one_to_ones"] == ["state"] or h["state"]["children"] == ["city"]
    other = spark.createDataFrame([("a",), ("b",)], "code string")
    assert [r.type for r in relations.discover_joins({"a": (df, ["state"]), "b": (other, ["code"])}).collect()] == ["11"]
    assert describe.override(list(fields.values()), "n", "year")[2].general == "t"


def field(name, general, scale="nominal", unique=False):
    return Field(name, "string", general, scale, 10, 0, 5, unique, False, False)


def test_hierarchies_and_counts_with_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, -3), ("a", nan, -2), ("b", 1.0, -1), (None, 2.0, None), ("b", None, 90), ("b", 1.0, -1)], "s string, x double, k int")
    got = {(r["parent"], r["child"]): (r["ratio"], r["is_edge"]) for r in relations.hierarchy_pairs(df.select("s", "x"), ["s", "x"]).collect()}
    assert got == {("s", "x"): (0.5, True), ("x", "s"): (1.0, True)}
    assert relations.hierarchy_pairs(df, ["s"]).count() == 0 and relations.hierarchy_pairs(df.limit(0), ["s", "x"]).count() == 0
    assert {tuple(r) for r in describe.counts(df).collect()} == {("s", 5, 1, 2), ("x", 5, 1, 3), ("k", 5, 1, 4)}
    short = {r[0]: r[1] for r in describe.contiguity(df.where("k < 0").withColumn("j", F.col("k") * 2), ["k", "j"]).collect()}
    assert short == {"k": True, "j": False} and not describe.contiguity(df, ["k"]).first()[1]


def test_planner():
    c = [field("c1", "c"), field("c2", "c")]
    q = [field("q1", "q", "continuous"), field("q2", "q", "continuous")]
    assert len(enumerate_specs([*c, *q], ["c1", "c2"], ("exact",))) == 2
    assert len(enumerate_specs([*c, *q], ["c1", "q1", "q2"], ("exact",))) == 4
    assert len(enumerate_specs([*c, *q], ["c1", "c2", "q1"], ("exact",))) == 11
    assert len(enumerate_specs([*c, *q], [], ("exact",))) == 4
    assert enumerate_specs([field("u", "c", unique=True)], [], ("baseline",)) == []
    assert len(enumerate_specs([*c, *q], ["c1"], ("expanded",))) <= 20


def test_fused_equals_unfused(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("b", None, 5.0), (None, 1.0, 1.0)], "k string, x double, y double")
    specs = [s for s in enumerate_specs([field("k", "c"), field("x", "q", "continuous"), field("y", "q", "continuous")], ["k", "x", "y"], ("subset",)) if s.procedure == "val:agg"]
    for spec, plan in compile_batch(specs, df).items():
        assert rows(plan) == rows(compile_spec(spec, df))


def test_scores():
    assert entropy([1, 1]) == pytest.approx(math.log(2)) and entropy([]) is None
    assert dispersion([1, 3]) == pytest.approx(1 / 3) and gini([1, 1, 1]) == 0


def test_tails():
    assert dist.t_sf2(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.f_sf(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert dist.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert dist.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-3)
    assert dist.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-3)
    assert dist.normal_sf(1.96) == pytest.approx(0.025, abs=1e-4)


def test_rank_tests_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "g string, x double")
    r = comparison.mann_whitney(df).first()
    assert (r.u, r.tied) == (1.0, 24.0)
    assert comparison.kruskal(df).first().h == pytest.approx(7 / 3 / (1 - 24 / 210))
    assert comparison.ks_2samp(df).first().d == pytest.approx(2 / 3)
    assert comparison.valid_tests(2, True, True) == ["mannwhitneyu", "kruskal", "ks_2samp", "ttest_ind", "f_oneway"]
    assert set(comparison.compare_columns(spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double"), ["a", "b"])) >= {"mannwhitneyu", "kruskal", "ks_2samp"}


def test_regression(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=200), rng.choice(["u", "v", "w"], 200)
    y = 1 + 2 * x + 3 * (c == "v") + rng.normal(scale=0.01, size=200)
    df = spark.createDataFrame([(float(a), str(b), float(d)) for a, b, d in zip(x, c, y, strict=True)], "x double, c string, y double")
    models = regression.regress(df, "y", ["x", "c"])
    full = dict((r[0], r[1]) for r in models[-1][1].rows)
    assert full["x"] == pytest.approx(2, abs=0.01) and full["c[v]"] == pytest.approx(3, abs=0.01) and full["intercept"] == pytest.approx(1, abs=0.01)
    assert set(regression.r2_contributions(models)) == {"x", "c"}
    assert regression.recommend_model(df, "y", ["x", "c"])[0] == "x"
    assert regression.lasso(df, "y", ["x"]) == ["x"]
    assert regression.auto_fit(df, "x", "y", ("x^1", "sin"), 0.5)[0] == ["x^1"]
    assert regression.anova(df, "y", ["c"])[0][1] == 2
    table, summary = regression.logistic(df.withColumn("hit", F.col("y") + F.col("x") * 0 > 1 + F.rand(3)), F.col("hit"), ["x"])
    assert table[0][1] > 0 and summary["n"] == 200
    assert correlation.correlate(df, ["x", "y"])[0][1][0] > 0.5


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name;n\n"x;y";1,234\nshort\né;3;4;5\nz;2\n'.encode("latin-1"))
    df = readers.read(spark, f"file://{tmp_path}/a.csv")
    assert rows(df.na.fill("?")) == [("short", "?"), ("x;y", "1,234"), ("z", "2")]
    (tmp_path / "b.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "c": 9}]')
    assert readers.read(spark, f"file://{tmp_path}/b.json").columns == ["a", "b"]
    (tmp_path / "empty.csv").write_text("a,b\n")
    assert readers.ingest(spark, f"file://{tmp_path}/empty.csv").count() == 0
    with pytest.raises(ValueError):
        readers.check_limits(df, rows=1)
    sinks.write_table(df, f"file://{tmp_path}/out", "tsv")
    assert sinks.to_json({"some_key": [float("nan"), datetime.date(2020, 1, 2)]}, True) == '{"someKey": [null, "2020-01-02"]}'


def test_facade(spark):
    df = spark.createDataFrame([("a", 1.5, 2), ("b", 2.5, 3), ("a", 3.5, 2), ("b", 0.5, 9)] * 3, "k string, x double, m int")
    data = Engine(spark).dataset(df)
    got = data.recommend(["k", "x"])
    assert got and got[0][0].relevance == 1.0
    assert data.compare(["x"], ["k"])["pairwise"][0]["a"] == "a"
    assert len(data.regress("x", ["m"])) == 1


def test_stream_counts(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 5), "a"), (datetime.datetime(2024, 1, 1, 0, 50), "a"), (datetime.datetime(2024, 1, 1, 2, 0), "b")], "ts timestamp, k string").write.parquet(src)
    stream = windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(src), "ts", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["value"], r["count"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_order_by_ranges(spark, monkeypatch):
    from gneiss.operators import ranges

    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 20)
    rng = np.random.default_rng(5)
    data = [(str(g), None if x > 95 else float(x)) for g, x in zip(rng.integers(0, 3, 400), rng.integers(0, 100, 400), strict=True)]
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    assert ranges.placed(df.where("x is not null"), ["x"]).select("part").distinct().count() > 5
    some = [(g, x) for g, x in data if x is not None]
    whole = ranges.quantiles(df, "x", (0.0, 0.1, 0.5, 0.93, 1.0)).first()
    assert list(whole) == pytest.approx(np.quantile([x for _, x in some], [0.0, 0.1, 0.5, 0.93, 1.0]).tolist())
    for r in ranges.quantiles(df, "x", (0.25, 0.75), ["g"]).collect():
        assert [r["q0"], r["q1"]] == pytest.approx(np.quantile([x for g, x in some if g == r["g"]], [0.25, 0.75]).tolist())
    assert ranges.quantiles(df.limit(0), "x", (0.5,)).first()["q0"] is None
    places = groupings.indexed_values(df.where("x is not null"), "x", ["x", "g"]).orderBy("index").collect()
    assert [r["index"] for r in places] == list(range(len(some))) and [r["value"] for r in places] == sorted(x for _, x in some)


def test_paired_tests(spark):
    scipy_like = [(1.0, 2.0, 3.0), (2.0, 2.0, 1.0), (5.0, 1.0, 4.0), (3.0, 3.0, 3.0), (4.0, 6.0, 5.0), (7.0, 1.0, 2.0)]
    df = spark.createDataFrame(scipy_like, "a double, b double, c double")
    w = comparison.wilcoxon(df, "a", "b").first()
    assert (w["n"], w["plus"], w["minus"], w["tied"]) == (4, 7.0, 3.0, 0.0)
    ranks = np.array([[1, 2, 3], [2.5, 2.5, 1], [3, 1, 2], [2, 2, 2], [1, 3, 2], [3, 1, 2]])
    n, k = ranks.shape
    tied = (2**3 - 2) + (3**3 - 3)
    chi2 = (12 / (n * k * (k + 1)) * (ranks.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)) / (1 - tied / (n * k * (k * k - 1)))
    assert comparison.friedman(df, ["a", "b", "c"]).first()["chi2"] == pytest.approx(chi2)
    assert set(comparison.compare_columns(df, ["a", "b"], False)) >= {"wilcoxon"} and set(comparison.compare_columns(df, ["a", "b", "c"], False)) == {"friedmanchisquare"}
    t, p, free = comparison.ttest_one(df, "a", 3.0)
    assert free == 5 and t == pytest.approx((22 / 6 - 3) / (np.std([1, 2, 5, 3, 4, 7], ddof=1) / math.sqrt(6))) and 0 < p < 1
    assert comparison.chi_square(spark.createDataFrame([("x",)] * 6 + [("y",)] * 2, "f string"), "f").first()["chi2"] == pytest.approx(2.0)


def test_multinomial_matches_the_binary_model(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=600)
    two = ["b" if rng.random() < 1 / (1 + math.exp(-(0.5 + 1.2 * v))) else "a" for v in x]
    df = spark.createDataFrame([(float(v), c, c if rng.random() < 0.8 else "z") for v, c in zip(x, two, strict=True)], "x double, two string, three string")
    table, summary = regression.multinomial(df, "two", ["x"])
    binary, other = regression.logistic(df, F.col("two") == "b", ["x"])
    for (_, label, b, se, *_), (label2, b2, se2, *_) in zip(table, binary, strict=True):
        assert label == label2 and b == pytest.approx(b2, abs=1e-3) and se == pytest.approx(se2, abs=1e-3)
    assert summary["llf"] == pytest.approx(other["llf"], abs=1e-3) and summary["llnull"] == pytest.approx(other["llnull"], abs=1e-3)
    table, summary = regression.multinomial(df, "three", ["x"])
    assert [r[0] for r in table] == ["b", "b", "z", "z"] and 0 < summary["r2"] < 1
    tests = regression.residual_tests(df.withColumn("y", 2 * F.col("x") + F.rand(1)), "y", ["x"])
    assert abs(tests["ttest_1samp"][0]) < 1e-6 and 0 <= tests["wilcoxon"][1] <= 1


def test_a_bad_spec_does_not_end_the_others(spark):
    from gneiss.plans.score import recommend, statistics, statistics_of

    df = spark.createDataFrame([(str(i % 3), float(i), i % 2) for i in range(30)], "g string, x double, h int")
    good, bad = make("val:agg", "c:q", grouped_field="g", agg_field="x", agg_fn="sum"), make("val:box", "c:q", grouped_field="g", boxed_field="nothing")
    errors = {}
    got = recommend(df, [good, bad], ["g"], errors=errors)
    assert [s.spec for s, _ in got] == [good] and list(errors) == [bad]
    assert recommend(df, [good], seconds=-1) == []
    plan = compile_spec(good, df)
    for a, b in zip(statistics(good, plan.collect()).values(), statistics_of(good, plan).values(), strict=True):
        assert a == pytest.approx(b)


def test_all_kinds_of_specs_fuse(spark):
    df = spark.createDataFrame([("k" + str(i % 3) if i % 7 else None, "m" + str(i % 2), float(i) if i % 5 else None, float(i * i % 11)) for i in range(80)], "c string, d string, x double, y double")
    fields = describe.profile(df)
    specs = enumerate_specs(fields, ["c", "d", "x", "y"])
    batch = compile_batch(specs, df)
    assert list(batch) == specs
    shared = [s for s, plan in batch.items() if "LocalRelation" in plan._jdf.queryExecution().optimizedPlan().toString()]
    assert {s.procedure for s in shared} >= {"val:agg", "val:count", "multigroup:agg", "multigroup:count", "agg:agg", "val:val:q"}
    for s, plan in batch.items():
        if s.procedure != "val:val":
            near = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
            assert near(plan.collect()) == near(compile_spec(s, df).collect()), s
    batch.release()


def test_large_shared_tables_are_cached_and_freed(spark, monkeypatch):
    from gneiss.plans import compile as plans

    monkeypatch.setattr(plans, "SHARED_ROWS", 2)
    monkeypatch.setattr(plans, "MAX_SETS", 1)
    df = spark.createDataFrame([("k" + str(i % 3), "m" + str(i % 4), float(i)) for i in range(40)], "c string, d string, x double")
    specs = [make("val:agg", "c:q", grouped_field=g, agg_field="x", agg_fn=fn) for g in "cd" for fn in ("sum", "mean")]
    bad = make("val:agg", "c:q", grouped_field="c", agg_field="nothing", agg_fn="sum")
    errors = {}
    batch = compile_batch([*specs, bad], df, errors=errors)
    assert len(batch.shared) == 2 and all(t.is_cached for t in batch.shared) and list(errors) == [bad]
    for s in specs:
        assert rows(batch[s]) == rows(compile_spec(s, df))
    tables = list(batch.shared)
    batch.release()
    assert not any(t.is_cached for t in tables)


def test_small_pieces_of_the_profile(spark):
    from gneiss.operators.binning import even_edges

    assert even_edges(0, 10, 4) == [0.0, 2.5, 5.0, 7.5, 10.1]
    assert describe.even_skips(list(range(10)), 3) == [0, 3, 6] and describe.even_skips([1], 3) == [1]
    df = spark.createDataFrame([("a,b", "x"), (None, ""), ("c, d,e", "y")], "l string, s string")
    assert {r["field"]: r["is_list"] for r in describe.delimited_lists(df, ["l", "s"]).collect()} == {"l": True, "s": False}
    assert sorted((r["field"], r["value"]) for r in describe.first_values(df, 5).collect()) == [("l", "a,b"), ("l", "c, d,e"), ("s", "x"), ("s", "y")]
    charts = {f.name: describe.field_chart(f) for f in describe.profile(spark.createDataFrame([(i, i % 4, i / 7, "k" + str(i % 2)) for i in range(200)], "row_id int, o int, q double, k string"))}
    assert charts["row_id"] is None and [charts[c].procedure for c in ("o", "q", "k")] == ["val:count", "bin:agg", "val:count"]
