"""Written intermediates, table sinks and size-checked broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir``.

    ``setCheckpointDir`` of the session comes first. Only a local-mode session may leave
    both unset (tests); there one machine is the whole cluster and a temporary folder,
    deleted at exit, will do.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="cloudgrain-")
        atexit.register(shutil.rmtree, _local_dirs[sc.applicationId], ignore_errors=True)
    return _local_dirs[sc.applicationId]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Values that depend on the run (partition numbers, row positions) become
    data, so a lost executor cannot change them on recomputation. Spark also
    knows the written size, so a later join picks broadcast only when it fits.
    The files lie under the application's id and may be deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/settled/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame that ``settle`` returned. What is lazily built on it must have been computed."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/settled/" in file:
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only when ``df`` has at most ``max_rows`` rows.

    Beyond that the plain DataFrame is returned and Spark joins by shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def save_table(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> None:
    """Overwrite a table, schema included."""
    writer = df.write.mode("overwrite").format("parquet").option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def table_or(spark: SparkSession, name: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """A stored table if it exists, otherwise the result of ``fallback()``."""
    return spark.table(name) if spark.catalog.tableExists(name) else fallback()


def save_chunks(df: DataFrame, path: str) -> None:
    """Replace the chunk store at ``path``; stale tiles go with the overwrite.

    Rows of one tile stay spread over the tasks that hold them, so a huge tile
    becomes several files in its folder.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("tile_name").parquet(path)


def save_colocated(df: DataFrame, name: str, buckets: int, keys: list[str], sort: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Overwrite a table dealt to ``buckets`` by ``keys``, and read it back.

    Tables with equal keys and buckets lie side by side: grouping them by the keys and joining or co-grouping them on the keys needs no shuffle.
    One task writes one bucket, so choose buckets for some 100 to 200 MB each.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *(sort or []))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
