"""Connected components by repeated smallest-neighbour steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklattice.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b: longs, any direction); component is its smallest node.

    Alternates large and small star steps: every node hands its larger (then its smaller) neighbours to the smallest node it
    knows, until each node points at the smallest of its component. Minima are partial before each shuffle, so a
    hub is no hot group; joins on a hub are split by adaptive execution. Each round is written to the shared folder. The number of
    rounds grows with the logarithm of the longest chain. Self-loops and repeated edges do no harm; an empty table gives no rows.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: larger neighbours of u move to the smallest around u.
        large = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: smaller neighbours of u, and u itself, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.filter("u <> v").distinct())
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
