"""Connected components of edges within groups, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.sources.store import kept


def _pull(edges: DataFrame, group: str, small: bool) -> DataFrame:
    """One star step over edges (group, a, b) with a > b: neighbours of a node go to the least of them and the node. Small
    stars take the smaller neighbours and the node itself, large stars the larger ones."""
    turned = edges.select(group, F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges if small else edges.unionByName(turned)
    least = around.groupBy(group, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    pulled = around.join(least, [group, "a"])
    moved = pulled.where("b <> m" if small else "b > a").select(group, F.col("b").alias("a"), F.col("m").alias("b"))
    out = moved.unionByName(least.where("a <> m").select(group, "a", F.col("m").alias("b"))) if small else moved
    return out.distinct()


def components(edges: DataFrame, group: str) -> DataFrame:
    """(group, a, b): for each node of an edge that isn't the least of its component, a, that least node, b.

    Edges (group, a, b) have any direction; loops and repeats are passed over. Every round is written, and the number of
    rounds grows with the logarithm of the nodes of a component. Nothing but a count and a digest comes to the driver.
    """
    tidy = edges.where("a <> b").select(group, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, was = kept(tidy, "edges"), None
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(group, "a", "b").cast("decimal(38,0)"))).first()
    while (state := digest(now)) != was:
        was = state
        now = kept(_pull(kept(_pull(now, group, small=False), "edges"), group, small=True), "edges")
    return now
