"""Histograms. Bins are half open; the last one is closed, so the maximum belongs to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import log_count
from ..schemas import KNOWN_CLASSES, class_name_of
from ..storage import settle
from .ranking import join_on


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value in [lo, hi]; null outside. A range of no width counts as one unit wide around it."""
    flat = lo == hi
    a = F.when(flat, lo - 0.5).otherwise(lo).cast("double")
    b = F.when(flat, hi + 0.5).otherwise(hi).cast("double")
    raw = F.floor((value - a) * bins / (b - a))
    return F.when((value >= a) & (value <= b), F.least(raw, F.lit(bins - 1)).cast("int"))


def density_grid(df: DataFrame, bins: int = 120, group: str = "classification", x: str = "x", y: str = "y") -> DataFrame:
    """Points per (group, x bin, y bin) over each group's own extent; empty bins are absent.

    Two map-side combined aggregates. The extents (one row per group) are written
    first, so that Spark sees how small they are and does not shuffle the points
    to join them; the result has at most ``bins**2`` rows per group.
    """
    box = df.groupBy(group).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    binned = join_on(df.select(group, x, y), settle(box), [group]).select(
        group,
        bin_index(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("bin_x"),
        bin_index(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("bin_y"))
    return (
        binned.groupBy(group, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n_points"))
        .withColumn("log10_points", F.round(log_count("n_points"), 6))
    )


def height_histogram(
    df: DataFrame, lo: float = -1.0, hi: float = 30.0, bins: int = 100, min_points: int = 10,
    group: str = "classification", z: str = "z",
) -> DataFrame:
    """Density per (known class, height bin) on [lo, hi].

    Points outside the range are not counted; a class with fewer than
    ``min_points`` points in all is left out.
    """
    b = bin_index(F.col(z), F.lit(lo), F.lit(hi), bins)
    counts = df.where(F.col(group).isin(*KNOWN_CLASSES)).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n_points"))
    per_class = W.partitionBy(group)  # at most bins + 1 rows each
    inside = F.sum(F.when(F.col("bin").isNotNull(), F.col("n_points"))).over(per_class)
    width = (hi - lo) / bins
    return (
        counts.withColumn("_all", F.sum("n_points").over(per_class)).withColumn("_in", inside)
        .where(F.col("bin").isNotNull() & (F.col("_all") >= min_points))
        .select(group, class_name_of(group).alias("class_name"), "bin", "n_points",
                (F.col("n_points") / (F.col("_in") * F.lit(width))).alias("density"))
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """All ``bins`` equal bins between the smallest and largest value, empty ones as 0.

    The two extremes are read first; as literals they need no join.
    """
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    index = bin_index(F.col(col), F.lit(lo).cast("double"), F.lit(hi).cast("double"), bins)
    counts = df.where(F.col(col).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if lo is None:
        lo = hi = 0.0
        bins = 0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    a, width = F.lit(lo), F.lit(hi - lo)
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", (a + width * F.col("bin") / bins).alias("bin_lo"), (a + width * (F.col("bin") + 1) / bins).alias("bin_hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))
