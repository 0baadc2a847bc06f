"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every node of the undirected edges: component is the smallest node it is connected with.

    Null ends and loops are left out, repeated edges count once. Each round is two aggregations and two joins on nodes whose
    edges have been pre-aggregated; a hub's neighbours are never gathered, only their minimum is."""
    e = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # large star: link each larger neighbour to the smallest node around
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link the smaller neighbours and the node itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small, "edges")
        # done when every node has one edge, and no node is both an end and a start
        many = now.groupBy("u").count().where("count > 1").limit(1).count()
        chain = now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        e = now
        if not many and not chain:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
