"""Conditionals compiled to Catalyst predicates, literals only."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def column(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clause(df: DataFrame, field: str, operation: str, criteria) -> Column | None:
    """One clause; None if the field is unknown or there is nothing to compare with."""
    if field not in df.columns or criteria is None:
        return None
    kind, col = df.schema[field].dataType, column(field)

    def literal(value):
        return F.lit(value).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(value)

    if operation in ("in", "not in"):
        found = col.isin(*[literal(v) for v in criteria])
        return found if operation == "in" else ~found
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    return OPERATIONS[operation](col, literal(criteria))


def condition(df: DataFrame, conditionals: Mapping[str, Sequence[Mapping]] | None) -> Column | None:
    """All clauses of `and` together, or any one of `or`: (a1 and a2 ...) or o1 or o2 ..."""
    if not conditionals:
        return None
    parts = {
        k: [c for x in conditionals.get(k) or () if (c := clause(df, x["field"], x["operation"], x["criteria"])) is not None] for k in ("and", "or")
    }
    terms = ([reduce(operator.and_, parts["and"])] if parts["and"] else []) + parts["or"]
    return reduce(operator.or_, terms) if terms else None


def resolve(conditionals: Mapping[str, Sequence[Mapping]], fields: Mapping) -> dict[str, list[dict]]:
    """P5: clauses that name a field by its id get its name and general type; clauses of unknown ids are left out."""
    return {
        k: [{**{n: v for n, v in x.items() if n != "field_id"}, "field": fields[x["field_id"]].name, "general": fields[x["field_id"]].general} for x in clauses if x["field_id"] in fields]
        for k, clauses in conditionals.items()
    }


def filtered(df: DataFrame, conditionals: Mapping[str, Sequence[Mapping]] | None) -> DataFrame:
    wanted = condition(df, conditionals)
    return df if wanted is None else df.where(wanted)


def dropna(df: DataFrame, fields: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Rows with a null (any) or with nothing but nulls (all) in the fields go; NaN counts as null."""
    return df.na.drop(how, subset=list(fields) if fields else None)
