"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step. Columns u > v. Large: neighbours above a node move to its least neighbour; small: the node and its neighbours below do."""
    near = edges.union(edges.select("v", "u")).toDF("n", "x") if large else edges.toDF("n", "x")
    least = near.groupBy("n").agg(F.min("x").alias("m")).select(F.col("n").alias("n2"), F.least("n", "m").alias("m"))
    joined = near.join(least, F.col("n") == F.col("n2"))
    if large:
        out = joined.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.inline(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("n").alias("u"), F.col("m").alias("v")))))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b); roots themselves have no row.

    The number of rounds grows with the logarithm of the longest path. It stops when a round changes nothing."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    mark = None
    for k in range(most_rounds):
        edges = written(_stars(_stars(edges, True), False), f"{name}-{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
