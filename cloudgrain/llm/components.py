"""Connected components of a link table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is its least node.

    Every round replaces links by links to smaller nodes; their number never grows. Each round
    is written, so lineage stays short. Hubs are plain join keys, which AQE can split.
    """
    stars = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    last = None
    while True:
        # Large star: each node's larger neighbours are linked to its least neighbour.
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # Small star: each node's smaller neighbours and itself are linked to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo")))
        stars = settle(small.where("hi > lo").distinct())
        if last is not None:
            discard(last)
        last = stars
        # Done when every node has one link at most and what it is linked to has none.
        ends = stars.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select("lo", F.lit(0), F.lit(1)).distinct())
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(stars.select("lo", "lo").distinct())
