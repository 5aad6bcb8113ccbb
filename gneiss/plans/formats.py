"""The forms in which a result leaves the engine, all made from one reading of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row

FORMATS = ("score", "visualize", "table", "count")
SHOWN = 5000


def tooltip(row: dict) -> str:
    """One line for a mark: each name with its value, and a mean with half the width of its band."""
    band = {"lower", "upper"} <= set(row) and None not in (row["lower"], row["upper"])
    parts = [f"{k}: {v:.3f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.items() if not (band and k in ("lower", "upper"))]
    return ", ".join(parts) + (f" ± {(row['upper'] - row['lower']) / 2:.3f}" if band else "")


def formats(rows: Sequence[Row], columns: Sequence[str], wanted: Sequence[str] = FORMATS) -> dict:
    """score: a list for each column; visualize: an object with its tooltip for each row; table: columns and a matrix; count: rows."""
    if unknown := set(wanted) - set(FORMATS):
        raise ValueError(f"unknown formats {sorted(unknown)}")
    make = {
        "score": lambda: {c: [r[i] for r in rows] for i, c in enumerate(columns)},
        "visualize": lambda: [{**(d := dict(zip(columns, r, strict=True))), "tooltip": tooltip(d)} for r in rows],
        "table": lambda: {"columns": list(columns), "data": [list(r) for r in rows]},
        "count": lambda: len(rows),
    }
    return {f: make[f]() for f in wanted}


def formatted(plan: DataFrame, wanted: Sequence[str] = FORMATS, limit: int = SHOWN) -> dict:
    """The forms of a result's first `limit` rows, from one job; count is of all its rows, by a second job where there are more."""
    rows = plan.limit(limit + 1).collect()
    out = formats(rows[:limit], plan.columns, wanted)
    if "count" in out and len(rows) > limit:
        out["count"] = plan.count()
    return out
