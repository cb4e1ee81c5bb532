"""Repeatable sampling and splitting.

Every choice is the digest of (purpose, seed, row key), so the same rows are picked
whatever the partitioning, the number of executors or the retry history. Each purpose has
digests of its own: a sample of a split's part, or of a sample, is a sample of all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digest, digest_below
from ..schemas import SEED
from .ranking import digest_threshold, within_threshold


def hash_sample(df: DataFrame, fraction: float, seed: int = SEED, key: str = "point_id", purpose: str = "sample") -> DataFrame:
    """Keep about ``fraction`` of the rows. Map-only. Samples of different purposes or seeds do not depend on each other."""
    return df.where(digest_below(digest(f"{purpose}:{seed}", key), fraction))


def sample_n_per_group(df: DataFrame, keys: list[str], n: int, seed: int = SEED, key: str = "point_id") -> DataFrame:
    """At most ``n`` rows of every group, the first in digest order.

    ``key`` must tell the rows of a group apart: rows that repeat it share a digest and are taken or left together.
    """
    seed = f"group:{seed}"
    limits = digest_threshold(df, keys, F.least(F.lit(n), F.col("_size")), [key], seed)
    return within_threshold(df, keys, limits, [key], seed, "_in").where("_in").drop("_in")


def stratified_split(
    df: DataFrame, label: str = "classification", test_fraction: float = 0.2, seed: int = SEED,
    key: str = "point_id", out: str = "split",
) -> DataFrame:
    """Mark rows ``train``/``test``; each class gives ``round(test_fraction * n)`` rows to test."""
    seed = f"split:{seed}"
    quota = F.floor(F.col("_size") * F.lit(test_fraction) + F.lit(0.5))
    limits = digest_threshold(df, [label], quota, [key], seed)
    marked = within_threshold(df, [label], limits, [key], seed, "_in")
    return marked.withColumn(out, F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def random_split(df: DataFrame, test_fraction: float = 0.2, seed: int = SEED, key: str = "point_id", out: str = "split") -> DataFrame:
    return df.withColumn(out, F.when(digest_below(digest(f"split:{seed}", key), test_fraction), "test").otherwise("train"))
