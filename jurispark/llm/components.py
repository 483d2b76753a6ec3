"""Connected components by label rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, materialize_with


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``pairs`` (a, b): the smallest node that can be reached.

    Large-star and small-star steps alternate until the edges are stars around their roots: each
    node hooks its larger (then its smaller) neighbours to the smallest one around it.  Edges
    never grow in number by more than the nodes, rounds grow with the logarithm of the longest
    path.  Neighbourhoods are reduced to their minimum before the join, so no list of a hot
    node's neighbours is gathered.  Rows with a NULL end are ignored.
    """
    edges = materialize(
        pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    )
    nodes = materialize(both_ways(edges).select(F.col("a").alias("node")).distinct())
    seen = None
    while True:
        around = both_ways(edges)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges, state = materialize_with(
            small,
            F.count(F.lit(1)).alias("n"),
            F.sum(F.hash("a", "b").cast("long")).alias("h"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x"),
        )
        if state == seen:
            break
        seen = state
    root = F.coalesce(F.col("b"), F.col("node")).alias("root")
    return nodes.join(edges, nodes["node"] == edges["a"], "left").groupBy("node").agg(
        F.min(root).alias("root")
    )
