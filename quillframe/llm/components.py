"""Connected components by alternating large-star and small-star, with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node among its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = durable(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("u", "m")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, which go from larger to smaller nodes, are stars: each node has one edge down or none, and those
    with one have none up. Then the centre of a star is its least node, and another round would change nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): of each node in ``edges`` (a, b: long), the smallest node that it can reach.

    Every round writes its edges, so none recomputes an earlier one. Rounds grow with the logarithm of the nodes; the
    work of a node with many neighbours is one partial minimum and one join between two plain shuffles, whose hot keys Spark can split.
    """
    now = durable(edges.where("a <> b").select("a", "b").distinct(), "edges")
    for _ in range(rounds):
        now = durable(_small_star(durable(_large_star(now), "large-star")), "edges")
        if _settled(now):
            break
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    roots = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
