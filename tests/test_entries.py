"""Forms of results, clauses by field id, and scores of whole columns."""

import random
from types import SimpleNamespace

import pytest

from gneiss.operators.predicates import filtered, resolve
from gneiss.plans.formats import formatted
from gneiss.plans.score import gini, gini_of


def test_forms_of_a_result(spark):
    plan = spark.createDataFrame([("a", 2.0, 1.5, 2.5), ("b", None, None, None)], "value string, agg double, lower double, upper double").coalesce(1)
    got = formatted(plan)
    assert got["score"] == {"value": ["a", "b"], "agg": [2.0, None], "lower": [1.5, None], "upper": [2.5, None]}
    assert got["table"] == {"columns": ["value", "agg", "lower", "upper"], "data": [["a", 2.0, 1.5, 2.5], ["b", None, None, None]]}
    assert [x["tooltip"] for x in got["visualize"]] == ["value: a, agg: 2.000 ± 0.500", "value: b, agg: None, lower: None, upper: None"]
    assert got["count"] == 2
    assert formatted(plan, ["count"], limit=1) == {"count": 2}
    assert formatted(plan.limit(0)) == {"score": {c: [] for c in plan.columns}, "visualize": [], "table": {"columns": plan.columns, "data": []}, "count": 0}
    with pytest.raises(ValueError):
        formatted(plan, ["picture"])


def test_clauses_by_field_id(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "n int, s string")
    fields = {7: SimpleNamespace(name="n", general="q"), 9: SimpleNamespace(name="s", general="c")}
    clauses = {"and": [{"field_id": 7, "operation": ">", "criteria": 1}, {"field_id": 1, "operation": "==", "criteria": 1}], "or": [{"field_id": 9, "operation": "==", "criteria": "x"}]}
    named = resolve(clauses, fields)
    assert named["and"] == [{"field": "n", "general": "q", "operation": ">", "criteria": 1}]
    assert sorted(r["n"] for r in filtered(df, named).collect()) == [1, 2, 3]
    assert resolve({}, fields) == {}


def test_gini_of_a_column(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, 1.0, 1.0, rng.random() * 9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "`a.b` double")
    row = gini_of(df, "a.b").first()
    assert row["n"] == 500 and abs(row["gini"] - gini(values)) < 1e-9
    zero = spark.createDataFrame([(0,), (0,)], "x int")
    assert tuple(gini_of(zero, "x").first()) == (2, None)
    assert tuple(gini_of(zero.limit(0), "x").first()) == (None, None)
