"""Newly arriving tiles: ingest, scoring and running quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import grid
from ..schemas import CELL_SIZE
from ..sources.las import BINARY_FILE, decode_files, list_files


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Each new scan file once, by name and size; Spark's file source keeps track of those seen."""
    return (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("pathGlobFilter", "*.las").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .load(path).select("path", "length")
    )


def stream_las(spark: SparkSession, path: str, files_per_batch: int = 1000, mode: str = "FAILFAST") -> DataFrame:
    """Points of new scan files as a stream."""
    return decode_files(stream_files(spark, path, files_per_batch), mode)


def ingest(points: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of points to a table partitioned by tile, then stop (``availableNow``)."""
    return (
        points.writeStream.format("parquet").partitionBy("tile_name").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def _tile_path(path):
    """Where a tile's files lie: its folder, or its only file."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(parent.endswith(".las"), parent).otherwise(path)


def score_new_tiles(
    spark: SparkSession, src: str, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000, mode: str = "FAILFAST",
) -> StreamingQuery:
    """Score every tile that got a new file and replace that tile in ``out``.

    A batch only says which tiles changed: at most ``files_per_batch``, and only their folders are listed. Each of them is read whole, all its
    files included, and overwritten as a partition, so replaying a batch after a
    failure gives the same table, and a tile whose files arrive in several
    batches is never left half scored. ``scorer`` maps points to predictions.
    """

    def replace(batch: DataFrame, _: int) -> None:
        touched = [r[0] for r in batch.select(_tile_path(F.col("path"))).distinct().collect()]
        if not touched:
            return
        (scorer(decode_files(list_files(batch.sparkSession, touched), mode)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("tile_name").parquet(out))

    return (
        stream_files(spark, src, files_per_batch).writeStream.foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running_accuracy(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Points and hits per group so far; works on a stream (``update`` or ``complete`` mode) and on a table alike.

    The state is one row per group.
    """
    hits = F.sum(F.col("correct").cast("long"))
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), hits.alias("n_correct"), (hits / F.count(F.lit(1))).alias("accuracy"))


def update_cells(points: DataFrame, out: str, checkpoint: str, z: str, size: float = CELL_SIZE) -> StreamingQuery:
    """Keep the state of every grid cell while points arrive: one folder of partial states per batch.

    A batch writes what its own points add to their cells, however many points came before; replayed, it overwrites
    its own folder. ``read_cells`` adds the parts up.
    """

    def add(batch: DataFrame, number: int) -> None:
        grid.cell_state(grid.with_cell(batch, size), z).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cells(spark: SparkSession, out: str, unit: float) -> DataFrame:
    """Statistics of every cell over all points so far."""
    return grid.stats_of(grid.merge_states(spark.read.parquet(out).drop("batch")), unit)


def keep_changes(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the groups that a batch touched, one folder per batch: an upsert that ``read_changes`` resolves.

    The running aggregate is keyed state in update mode, so a batch writes as many rows as it touched groups, not the whole
    result. A batch that is replayed after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        result.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_changes(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Every group as its last batch left it."""
    every = spark.read.parquet(out)
    rest = [c for c in every.columns if c not in {*keys, "batch"}]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def keep_latest(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the whole (small) result of a running aggregate after every batch, one folder per batch.

    A batch that is replayed after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        result.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """Result after the newest batch."""
    every = spark.read.parquet(out)
    newest = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == newest).drop("batch")
