"""Exact ranks and running values over groups too large for one task.

A window function puts a whole group into one task. Here rows are dealt to ranges of (group, order) instead,
so a group of any size spreads over as many tasks as its rows need. A range numbers its own rows, and a
small table with one row per (group, range) carries the totals of the ranges before it.

The ranges' bounds come from a sample by hash and are literals of the plan, so a row's range depends on the row alone and a lost task
computes the same again: only the small table is written (``rank_within``, ``running_min``). The rows are
read for the sample, the counts and the result; where that costs more than writing them once, ``rank_written`` lays
them out in a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digest
from ..storage import settle

SAMPLES = 32  # sampled rows per range that its bounds come from
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row position in its low 33 bits


def ordered_layout(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in global (keys, order) order with their partition ``_p`` and position ``_i``.

    ``order`` should end in a column that tells rows apart, as rows equal in all of
    it share a partition. One shuffle. Written down, because both columns must not change when a lost
    partition is computed again.
    """
    cols = [F.col(c) for c in [*keys, *order]]
    # Without a number, AQE may merge neighbouring small partitions; the order stays.
    laid = df.repartitionByRange(*([partitions] if partitions else []), *cols).sortWithinPartitions(*cols)
    return settle(laid.select(
        "*",
        F.spark_partition_id().alias("_p"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_i"),
    ))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, so no row is lost; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _attach(laid: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    # One carried row per (group, partition). It is written, so its size is known
    # and Spark broadcasts it only below autoBroadcastJoinThreshold.
    return join_on(laid, settle(carried), [*keys, "_p"], "left")


def _bounds(df: DataFrame, cols: list[str], ranges: int) -> list:
    """At most ``ranges - 1`` rows that cut the distinct values of ``cols`` evenly, from a sample by hash."""
    n = df.count()
    fraction = min(1.0, ranges * SAMPLES / max(n, 1))
    picked = F.pmod(F.xxhash64(F.lit("bounds"), *cols), F.lit(1 << 30)) < int(fraction * (1 << 30))
    # Rows that repeat a value are in or out together, and count once. A filter here would be moved below the columns and repeat
    # their expressions for every use; grouping sends the rows that are not picked as one null.
    own = F.when(picked, F.struct(*[F.col(c).alias(c) for c in cols])).alias("_own")
    seen = [r[0] for r in df.select(own).distinct().orderBy("_own").collect() if r[0] is not None]
    step = max(1, len(seen) // ranges)
    return seen[step::step][:ranges - 1]


def with_range(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None, out: str = "_p") -> DataFrame:
    """``df`` with the number of the (keys, order) range of each row, from literal bounds: no shuffle, nothing written.

    ``df`` must give the same rows whenever it is computed; values that depend on the run have to be settled first.
    """
    cols = [*keys, *order]
    ranges = ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, cols, ranges)
    if not bounds:
        return df.withColumn(out, F.lit(0))
    kinds = [df.schema[c].dataType for c in cols]
    table = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, cols)]) for b in bounds])
    # Binary search for the number of bounds before the row, a column per step: all of it is generated code, and the
    # row's own values, however dear, are computed once.
    laid = df.withColumn("_own", F.struct(*[F.col(c).alias(c) for c in cols])).withColumn(out, F.lit(0))
    for bit in range(len(bounds).bit_length() - 1, -1, -1):
        before = F.get(table, F.col(out) + F.lit((1 << bit) - 1)) < F.col("_own")  # null beyond the last bound
        laid = laid.withColumn(out, F.when(before, F.col(out) + F.lit(1 << bit)).otherwise(F.col(out)))
    # As the key of a join, Spark's search for runtime filters would write its steps out, each of them three times
    # in the next, with the row's own values in all: gigabytes on the driver. It does not look behind a generator.
    return laid.drop("_own").withColumn(out, F.explode(F.array(out)))


def rank_within(
    df: DataFrame, keys: list[str], order: list[str], out: str = "rn",
    total: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """``row_number`` (and group size) per group, without one task per group. One shuffle; only counts are written.

    ``order`` should end in a column that tells rows apart, as rows equal in all of it share a range. ``partitions`` is the number of ranges.
    """
    laid = with_range(df, keys, order, partitions)
    # Windows over this table: for one group, at most one row per range.
    heads = settle(laid.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n")))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(W.partitionBy(*keys)).alias("_in_group"))
    own = F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order))
    ranked = join_on(laid.withColumn("_i", own), settle(carried), [*keys, "_p"]).withColumn(out, F.col("_base") + F.col("_i"))
    if total:
        ranked = ranked.withColumn(total, F.col("_in_group"))
    return ranked.drop("_p", "_i", "_base", "_in_group")


def running_min(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, partitions: int | None = None,
) -> DataFrame:
    """Cumulative minimum of ``value`` in ``order``, per group of any size. One shuffle; only the ranges' minima are written."""
    laid = with_range(df, keys, order, partitions)
    heads = settle(laid.groupBy(*keys, "_p").agg(F.min(value).alias("_m")))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = settle(heads.select(*keys, "_p", F.min("_m").over(before).alias("_prev")))
    local = W.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = join_on(laid.withColumn("_own", F.min(value).over(local)), carried, [*keys, "_p"])
    return ranked.withColumn(out, F.least("_own", "_prev")).drop("_p", "_own", "_prev")


def rank_written(
    df: DataFrame, keys: list[str], order: list[str], out: str = "rn",
    total: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """Like ``rank_within``; ``df`` is computed once, range-partitioned and written."""
    laid = ordered_layout(df, keys, order, partitions)
    # Windows below run over this table: for one group, at most one row per partition.
    heads = laid.groupBy(*keys, "_p").agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = heads.select(
        *keys, "_p",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") + 1).alias("_base"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_in_group"),
    )
    ranked = _attach(laid, carried, keys).withColumn(out, F.col("_base") + F.col("_i"))
    if total:
        ranked = ranked.withColumn(total, F.col("_in_group"))
    return ranked.drop("_p", "_i", "_base", "_in_group")


def digest_threshold(
    df: DataFrame, keys: list[str], quota: Column, id_cols: list[str], seed, digits: int = 3, max_bucket: int = 1_000_000,
) -> DataFrame:
    """Per group, the digest of its ``quota``-th row in digest order.

    ``quota`` is an expression over the keys and the group size ``_size``. Result
    ``(keys, _size, _quota, _thr, _thr_id)``; ``_thr`` is null where the quota
    takes the whole group, and empty text where it takes nothing. No full shuffle:
    a histogram over digest prefixes (map-side combined) finds the bucket in
    which the quota falls, and only that bucket's rows are ranked. While such a
    bucket holds more than ``max_bucket`` rows, a longer prefix divides it again.
    """
    dig = digest(seed, *id_cols)
    rows = df.select(*keys, *[c for c in id_cols if c not in keys], dig.alias("_d"))

    def edge_of(counted: DataFrame, prefix: int, need: Column, held: list[str]) -> DataFrame:
        """Bucket of ``prefix`` digits in which each group's ``need``-th row lies."""
        hist = counted.groupBy(*keys, *held, F.substring("_d", 1, prefix).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
        cum = hist.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_in", F.sum("_c").over(W.partitionBy(*keys)))
        if not held:
            cum = cum.withColumn("_size", F.col("_in")).withColumn("_quota", quota.cast("long"))
        rest = need - F.col("_cum") + F.col("_c")
        first = F.min(F.when(F.col("_cum") >= need, F.struct("_b", rest.alias("_need"), "_c")))
        return settle(cum.groupBy(*keys, "_size", "_quota").agg(first.alias("_e"))
                      .select(*keys, "_size", "_quota", "_e._b", "_e._need", "_e._c"))

    def in_edge(prefix: int) -> DataFrame:
        open_edge = edge.where((F.col("_quota") > 0) & (F.col("_quota") < F.col("_size"))).drop("_c")
        return join_on(rows.withColumn("_b", F.substring("_d", 1, prefix)), open_edge, [*keys, "_b"])

    edge = edge_of(rows, digits, F.col("_quota"), [])
    sizes, prefix = edge, digits
    while prefix + digits <= 32 and (edge.agg(F.max("_c")).first()[0] or 0) > max_bucket:
        edge = edge_of(in_edge(prefix).drop("_b"), prefix + digits, F.col("_need"), ["_size", "_quota", "_need"])
        prefix += digits
    inside = in_edge(prefix)
    w = W.partitionBy(*keys).orderBy("_d", *id_cols)
    hit = (
        inside.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == F.col("_need"))
        .select(*keys, F.col("_d").alias("_thr"), F.struct(*id_cols).alias("_thr_id"))
    )
    return settle(
        join_on(sizes.drop("_b", "_need", "_c"), hit, keys, "left")
        .withColumn("_thr", F.when(F.col("_quota") <= 0, F.lit("")).otherwise(F.col("_thr")))
    )


def within_threshold(df: DataFrame, keys: list[str], limits: DataFrame, id_cols: list[str], seed, out: str) -> DataFrame:
    """Mark the rows at or before their group's digest threshold; a map-only pass plus a small join."""
    dig = digest(seed, *id_cols)
    ids = F.struct(*id_cols)
    hit = (
        F.col("_thr").isNull() | (dig < F.col("_thr")) | ((dig == F.col("_thr")) & (ids <= F.col("_thr_id")))
    )
    return join_on(df, limits, keys).withColumn(out, hit).drop("_thr", "_thr_id", "_size", "_quota")
