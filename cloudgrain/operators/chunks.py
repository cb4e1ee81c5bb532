"""Fixed-size chunks of a tile: assignment, padding, pyramid, packing, batches.

A chunk never holds more than ``n_pts`` points, so a window or a grouped pandas
function over (tile, chunk) is bounded work. A tile is not bounded; its rows
are numbered by :func:`rank_within`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cell_index, digest, digest_int, interleave2
from ..schemas import CELL_SIZE, CHUNK_MIN_POINTS, CHUNK_POINTS, PYRAMID_RATIO, PYRAMID_STAGES, SEED
from ..storage import settle
from .ranking import rank_within

CHUNK = ["tile_name", "chunk_idx"]


def morton_code(size: float = CELL_SIZE, x: str = "x", y: str = "y"):
    """Z-order code of a point's grid cell; cells are shifted by 2**30 to be non-negative."""
    shift = F.lit(1 << 30)
    return interleave2(cell_index(x, size) + shift, cell_index(y, size) + shift)


def assign_chunks(
    df: DataFrame, n_pts: int = CHUNK_POINTS, min_pts: int = CHUNK_MIN_POINTS, order: str | list[str] = "point_id",
    tile: str = "tile_name", partitions: int | None = None, cell: float = CELL_SIZE,
) -> DataFrame:
    """Cut every tile into runs of ``n_pts`` points in the given order.

    Adds ``chunk_idx``, ``pos`` and ``chunk_n``. A last chunk shorter than
    ``min_pts`` is dropped. ``order="morton"`` walks the grid cells in Z-order,
    which keeps a chunk's points near each other.
    """
    if order == "morton":
        df = df.withColumn("_z", morton_code(cell))
        order_cols = ["_z", "point_id"]
    else:
        order_cols = [order] if isinstance(order, str) else list(order)
    ranked = rank_within(df, [tile], order_cols, "_rn", total="_total", partitions=partitions)
    idx = F.floor((F.col("_rn") - 1) / n_pts).cast("int")
    return (
        ranked.withColumn("chunk_idx", idx)
        .withColumn("pos", ((F.col("_rn") - 1) % n_pts).cast("int"))
        .withColumn("chunk_n", F.least(F.lit(n_pts), F.col("_total") - F.col("chunk_idx").cast("long") * n_pts).cast("int"))
        .where(F.col("chunk_n") >= min_pts)
        .drop("_rn", "_total", "_z")
    )


def pad_chunks(chunked: DataFrame, n_pts: int = CHUNK_POINTS, seed: int = SEED) -> DataFrame:
    """Fill short chunks to ``n_pts`` rows with repeats of their own points.

    Only a tile's last chunk can be short, so the join that fetches the repeats
    touches at most one chunk per tile. Adds ``padded``.
    """
    short = chunked.where(F.col("chunk_n") < n_pts)
    missing = (
        short.where(F.col("pos") == 0).select(*CHUNK, "chunk_n")
        .withColumn("_to", F.explode(F.sequence(F.col("chunk_n"), F.lit(n_pts - 1))))
        .select(*CHUNK, "_to", F.pmod(digest_int(digest(seed, *CHUNK, "_to")), F.col("chunk_n")).cast("int").alias("pos"))
    )
    extra = short.join(missing, [*CHUNK, "pos"]).drop("pos").withColumnRenamed("_to", "pos")
    return chunked.withColumn("padded", F.lit(False)).unionByName(
        extra.select(*chunked.columns, F.lit(True).alias("padded"))
    )


def downsample_pyramid(
    chunked: DataFrame, stages: int = PYRAMID_STAGES, ratio: int = PYRAMID_RATIO, seed: int = SEED,
    key: str = "point_id", by: list[str] | None = None,
) -> DataFrame:
    """Coarsest stage each point survives to, as ``top_stage`` (0 = full resolution only).

    Stage s keeps ``max(floor(n / ratio**s), 1)`` points. One random rank per
    chunk gives all stages, nested in each other.
    """
    by = by or CHUNK
    extra = [] if key == "pos" else ["pos"]
    order = W.partitionBy(*by).orderBy("_d", key, *extra)
    ranked = (
        chunked.withColumn("_d", digest(f"pyramid:{seed}", key))
        .withColumn("_r", F.row_number().over(order))
        .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    )
    top = F.lit(0)
    for s in range(1, stages + 1):
        keep = F.greatest(F.floor(F.col("_n") / F.lit(ratio**s)), F.lit(1))
        top = F.when(F.col("_r") <= keep, F.lit(s)).otherwise(top)
    return ranked.withColumn("top_stage", top.cast("int")).drop("_d", "_r", "_n")


def pyramid_members(pyramid: DataFrame, stages: int | None = None) -> DataFrame:
    """One row per (stage, point): the point set of every resolution."""
    top = F.col("top_stage") if stages is None else F.least(F.col("top_stage"), F.lit(stages))
    return pyramid.withColumn("stage", F.explode(F.sequence(F.lit(0), top))).drop("top_stage")


def pyramid_summary(pyramid: DataFrame) -> DataFrame:
    """Points kept per chunk and stage."""
    return pyramid_members(pyramid).groupBy(*CHUNK, "stage").agg(F.count(F.lit(1)).alias("n_points"))


def chunk_list(chunked: DataFrame) -> DataFrame:
    """One row per chunk; every chunk has exactly one row at position 0."""
    return chunked.where(F.col("pos") == 0).select(*CHUNK, "chunk_n")


def cap_chunks(chunked: DataFrame, n: int) -> DataFrame:
    """Points of the first ``n`` chunks in (tile, chunk) order."""
    first = chunk_list(chunked).select(*CHUNK).orderBy(*CHUNK).limit(n)
    return chunked.join(F.broadcast(first) if n <= 100_000 else first, CHUNK, "left_semi")


def pack_chunks(chunked: DataFrame, cols: list[str]) -> DataFrame:
    """One row per chunk with its rows as an array in position order (at most ``n_pts`` long)."""
    packed = F.sort_array(F.collect_list(F.struct("pos", *cols)))
    return chunked.groupBy(*CHUNK).agg(packed.alias("points"))


def unpack_chunks(packed: DataFrame) -> DataFrame:
    return packed.select(*CHUNK, F.inline("points"))


def assign_shard(chunks: DataFrame, n_shards: int, partitions: int | None = None) -> DataFrame:
    """Deal the sorted chunk list round-robin to ``n_shards`` workers.

    The list is short but may be dear to compute (points cut into chunks), and ranking reads it more than once: it is written first.
    """
    ranked = rank_within(settle(chunks), [], CHUNK, "_rn", partitions=partitions)
    return ranked.withColumn("shard", ((F.col("_rn") - 1) % n_shards).cast("int")).drop("_rn")


def by_shard(df: DataFrame, n_shards: int) -> DataFrame:
    """Co-locate each shard's rows: partition i holds shard i."""
    return df.repartitionById(n_shards, "shard")


def assign_batches(
    sharded: DataFrame, size: int, epoch: int = 0, seed: int = SEED, keep_tail: bool = False, partitions: int | None = None,
) -> DataFrame:
    """Shuffle each shard's chunks for an epoch and cut them into batches of ``size``.

    An incomplete last batch is dropped unless ``keep_tail``.
    """
    shuffled = sharded.withColumn("_d", digest(f"{seed}:{epoch}", *CHUNK))
    ranked = rank_within(shuffled, ["shard"], ["_d", *CHUNK], "_rn", total="_total", partitions=partitions)
    batched = (
        ranked.withColumn("epoch", F.lit(epoch))
        .withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("int"))
        .withColumn("slot", ((F.col("_rn") - 1) % size).cast("int"))
    )
    if not keep_tail:
        batched = batched.where(F.col("batch") < F.floor(F.col("_total") / size))
    return batched.drop("_rn", "_total", "_d")
