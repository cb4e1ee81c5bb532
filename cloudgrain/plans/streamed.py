"""Queries that run a stream to its end over files Spark wrote from the points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import veg_class
from ..operators.grid import cell_features
from ..sources.las import register, save_las
from ..storage import work_dir
from ..streaming import tiles
from .registry import query
from .tables import points, predictions

_POINT = ["x", "y", "z", "intensity", "classification", "tile_name"]


def _folder(spark) -> str:
    return f"{work_dir(spark)}/stream/{uuid.uuid4().hex}"


@query("stream_ingest", "SELECT tile_name, x, y, z, intensity, classification FROM points")
def stream_ingest(spark, sf):
    at = _folder(spark)
    save_las(points(spark, sf).select(*_POINT), f"{at}/las")
    tiles.ingest(tiles.stream_las(spark, f"{at}/las", files_per_batch=8), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/table").select("tile_name", *[F.round(c, 3).alias(c) for c in "xyz"], "intensity", "classification")


@query("stream_scoring", "SELECT tile_name, x, y, CASE WHEN z < 4 THEN 3 WHEN z < 10 THEN 4 ELSE 5 END AS predicted_class FROM points")
def stream_scoring(spark, sf):
    at = _folder(spark)
    save_las(points(spark, sf).select(*_POINT), f"{at}/las")

    def scorer(pts):
        return cell_features(pts).withColumn("predicted_class", veg_class(F.round("z", 3)))

    tiles.score_new_tiles(spark, f"{at}/las", scorer, f"{at}/table", f"{at}/checkpoint", files_per_batch=8).awaitTermination()
    return spark.read.parquet(f"{at}/table").select("tile_name", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "predicted_class")


@query("stream_accuracy", """SELECT tile_name, classification, count(*) AS n_points, CAST(sum(CAST(classification = predicted_class AS INT)) AS BIGINT) AS n_correct,
  CAST(sum(CAST(classification = predicted_class AS INT)) AS DOUBLE)/count(*) AS accuracy FROM points GROUP BY tile_name, classification""")
def stream_accuracy(spark, sf):
    at = _folder(spark)
    table = predictions(spark, sf).select("tile_name", "classification", "correct")
    table.repartition(4).write.parquet(f"{at}/in")
    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream = tiles.running_accuracy(feed, ["tile_name", "classification"])
    tiles.keep_changes(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return tiles.read_changes(spark, f"{at}/out", ["tile_name", "classification"])


@query("stream_cells", "SELECT * FROM stats", "points celled stats")
def stream_cells(spark, sf):
    """Cell statistics kept up to date while the points arrive in parts."""
    at = _folder(spark)
    table = points(spark, sf).select("tile_name", "x", "y", "z_mm")
    table.repartition(5).write.parquet(f"{at}/in")
    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    tiles.update_cells(feed, f"{at}/cells", f"{at}/checkpoint", "z_mm").awaitTermination()
    return tiles.read_cells(spark, f"{at}/cells", 1000)


@query("stream_format", "SELECT tile_name, x, y, z, intensity, classification FROM points")
def stream_format(spark, sf):
    """The scan files as a stream of their own format, in two runs from one checkpoint."""
    at = _folder(spark)
    half = F.xxhash64("tile_name") % 2 == 0
    register(spark)
    pts = points(spark, sf).select(*_POINT)
    for part in (half, ~half):
        save_las(pts.where(part), f"{at}/las", mode="append")
        tiles.ingest(spark.readStream.format("las").load(f"{at}/las"), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/table").select("tile_name", *[F.round(c, 3).alias(c) for c in "xyz"], "intensity", "classification")
