"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node with the least of them (and the node itself); large: only those above the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))  # added up in parts, so no task holds a node's edges
    near = both.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of edges (u, v), the least node that it can reach.

    Every round is a few joins and counts in parts; the number of rounds is logarithmic in the number of nodes. The driver sees one
    sum each round, by which it knows the edges of the last round to be stars already.
    """
    down = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = stored(down, "component-edges")
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    last = None
    while True:
        down = stored(_star(_star(down, True), False), "component-edges")
        now = down.agg(sign.alias("s")).first()["s"]
        if now == last:
            break
        last = now
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
