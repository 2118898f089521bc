"""Connected components of a graph that is too large for one machine."""

from pyspark.sql import DataFrame, functions as F

from fraudwatch.session import settle


def connected(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, for every node of the links (a, b).

    Alternates large-star and small-star steps: every node's larger, then smaller
    neighbours are hung on its smallest one.  A node's neighbours are never
    gathered: the smallest is an aggregate, and the links are joined with it.
    The steps end when each link joins a node with its component's smallest.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: neighbours above a node go to the smallest node around it.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        settled = settle(small)
        # Done when no node hangs on two others, and none that hangs on one carries another: every link ends at a root.
        ends = settled.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")).unionByName(
            settled.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("carries"))
        )
        roles = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("carries").alias("carries"))
        if roles.where("hangs > 1 OR hangs = 1 AND carries = 1").isEmpty():
            break
        edges = settled
    roots = settled.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return settled.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
