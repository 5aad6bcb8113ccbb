"""P1, P8, J1, J2 and derived fields: reshaping a table."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column

ARITHMETIC = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": lambda a, b: F.try_divide(a, b)}


def reduce_columns(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The columns at the given positions, in the given order."""
    return df.select(*[column(df.columns[i]) for i in positions])


def unpivot(df: DataFrame, fields: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Long form of the fields; all other columns stay as ids. Fields of several types become text."""
    ids = [c for c in df.columns if c not in set(fields)]
    kinds = {df.schema[f].dataType for f in fields}
    numeric = all(isinstance(k, T.NumericType) for k in kinds)
    cast = None if len(kinds) == 1 else "double" if numeric else "string"
    values = [column(f).cast(cast).alias(f) if cast else column(f) for f in fields]
    return df.select(*[column(i) for i in ids], *values).unpivot(ids, list(fields), variable, value)


def join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | None = None,
    left_on: Sequence[str] | None = None,
    right_on: Sequence[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"),
    match_nulls: bool = False,
) -> DataFrame:
    """Equi-join on columns of one name, or of two. Other columns of one name get the suffixes.

    how is inner, left, right or outer. Null keys match nothing unless match_nulls is set, as frames in
    memory do. With `on`, the key column takes whichever side has it. Join strategy is Catalyst's.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join {how!r}")
    lk, rk = list(on or left_on or ()), list(on or right_on or ())
    if not lk or len(lk) != len(rk):
        raise ValueError("as many keys on the left as on the right, one at least")
    shared = set(left.columns) & set(right.columns) - (set(lk) if on else set())
    names_l = {c: c + suffixes[0] if c in shared else c for c in left.columns}
    names_r = {c: c + suffixes[1] if c in shared else c for c in right.columns}
    marks = [f"__key{i}" for i in range(len(rk))] if on else []
    a = left.select(*[column(c).alias(n) for c, n in names_l.items()])
    b = right.select(*[column(c).alias(marks[rk.index(c)] if on and c in rk else n) for c, n in names_r.items()])
    sides = [(column(names_l[x]), column(marks[i] if on else names_r[y])) for i, (x, y) in enumerate(zip(lk, rk, strict=True))]
    same = reduce(operator.and_, [x.eqNullSafe(y) if match_nulls else x == y for x, y in sides])
    out = a.join(b, same, how)
    if not on:
        return out
    keys = {x: F.coalesce(column(x), column(marks[i])).alias(x) for i, x in enumerate(lk)}
    return out.select(*[keys.get(c, column(n)) for c, n in names_l.items()], *[column(n) for c, n in names_r.items() if c not in rk])


def derive(df: DataFrame, name: str, operation: str, a: str, b: str) -> DataFrame:
    """A new column from two others by add, subtract, multiply or divide (by zero: null)."""
    return df.withColumn(name, ARITHMETIC[operation](column(a), column(b)))


def sample_page(df: DataFrame, order: Sequence[str], start: int = 0, size: int = 100) -> DataFrame:
    """One page of the table in an explicit order."""
    return df.orderBy(*[column(c) for c in order]).offset(start).limit(size)


def random_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """O3: n rows drawn by a seeded shuffle, kept as a bounded top-n."""
    return df.orderBy(F.rand(seed)).limit(n)
