"""Connected components by alternating large-star and small-star rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours to the smallest node that it knows.

    Large: neighbours above the node. Small: neighbours below it, and the node itself. The minimum is aggregated before the
    shuffle; the join with a hub's links has nothing after it that needs them together, so a skewed one can be split.
    """
    if small:
        near = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
    low = near.groupBy("n").agg(F.least(F.min("v"), F.first("n")).alias("m")) if not small else near.groupBy("n").agg(F.min("v").alias("m"))
    linked = near.join(low, "n")
    if small:
        out = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.where(F.col("v") > F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every node on an edge (a, b); component is the smallest id. Nodes without an edge are not listed.

    Rounds grow with the logarithm of the longest path, so max_rounds is a guard only: reaching it is an error, never a partial result.
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # When every node hangs on one root, and no root hangs on another, further rounds change nothing.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        now = cut(_stars(_stars(now, small=False), small=True), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component")).distinct()
