"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import discard, materialize


ROWS_PER_TASK = 200_000


def _step(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One star step over edges (a, b) with a > b, which are deleted. Minima are written first, so the join with a hub's many edges can be split."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", parts)
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = materialize(out.where("a != b").distinct(), "edges", parts)
    discard(least, edges)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one edge to a root, and no root has one itself."""
    seen = edges.select("a", F.lit(0).alias("root")).union(edges.select(F.col("b").alias("a"), F.lit(1).alias("root")))
    odd = seen.groupBy("a").agg(F.max("root").alias("root"), F.sum(1 - F.col("root")).alias("n")).where("n > 1 or (n = 1 and root = 1)")
    return odd.limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it can reach.

    edges has two long columns a and b. Nulls and loops are dropped, repeated edges count once, an
    empty table gives an empty one.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    parts = 4 + edges.count() // ROWS_PER_TASK
    now = materialize(now.distinct(), "edges", parts)
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = _step(_step(now, True, parts), False, parts)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = materialize(stars.union(now.select(F.col("b"), F.col("b"))).distinct(), "roots", parts)
    discard(now)
    return roots
