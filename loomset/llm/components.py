"""Connected components of an edge table: alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import scratch_root


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. edges: (u, v). Large: neighbours above u move to the least neighbour; small: those below."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, each once, are stars: every u has one v, and no v is a u. A round would leave them as they are."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or above > 0 and below > 0").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every vertex of (u bigint, v bigint) with the least vertex of its component: (node, label).

    Vertices without an edge to another vertex are not returned. Self loops and repeated edges are allowed.
    Nothing is collected; each round ends in a checkpoint in the shared folder. Edges that are stars already take no
    round, and none only proves the last: a round costs the driver far more than the look at the stars. Raises if rounds run out.
    """
    scratch_root(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for at in range(max_rounds + 1):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        if at < max_rounds:
            now = _star(_star(now, True), False).checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
