"""Derived tables and JSON forms."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A derived table; tsv keeps a header."""
    if kind == "tsv":
        df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def encode(value, camel_case: bool = False):
    """Plain JSON values: times as ISO text with a space, rows as objects, NaN as null."""
    if isinstance(value, datetime):
        return value.isoformat(" ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value != value:
        return None
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, Mapping):
        return {camel(str(k)) if camel_case else str(k): encode(v, camel_case) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [encode(v, camel_case) for v in value]
    return value


def to_json(value, camel_case: bool = False) -> str:
    return json.dumps(encode(value, camel_case))
