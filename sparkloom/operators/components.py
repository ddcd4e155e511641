"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkloom.util import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(a, b) links of longs -> (node, component), the component being its smallest node.

    Nodes without a link do not appear. Each round is two aggregations with map-side
    combine and two equi-joins whose hot keys AQE can split; lineage is cut by a table
    in the shared folder. Stars of any size converge in a logarithmic number of rounds.
    """
    now = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: every node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        near = large.select(F.col("b").alias("u"), F.col("a").alias("v")).union(low.select("u", F.col("u").alias("v")))
        small = near.join(low, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        after = scratch.keep(small)
        # done once every node hangs on exactly one centre and no centre hangs on another
        centres = after.select(F.col("a").alias("x")).distinct()
        chained = after.join(centres, after.b == centres.x, "left_semi").limit(1).count()
        several = 0 if chained else after.groupBy("b").count().filter("count > 1").limit(1).count()
        scratch.drop(now)
        now = after
        if not chained and not several:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
