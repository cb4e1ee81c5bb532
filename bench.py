"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every result is computed whole (``noop`` sink, all columns), once, after a run
over the smallest tables has loaded classes and generated code. ``rates`` is
input points per second. Times go to stderr as they come; a query that fails is named under ``failed``. ``chunk_classifier`` does the work of the published
training benchmark (100 chunks of 4,096 points: neighbour graphs, features,
fit, accuracy) on all chunks of the table.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from cloudgrain.plans import QUERIES
from cloudgrain.plans.tables import points

HEADLINE = [
    "tile_summary", "class_distribution", "cell_features", "confusion_long", "classification_report", "density_grid",
    "stratified_split", "assign_chunks", "downsample_pyramid", "knn_chunk", "knn_grid", "nearest_upsample",
    "softmax_pool", "multiscale_features", "las_roundtrip", "rf_score", "boosted_score", "chunk_classifier",
]
LAS_RECORD_BYTES = 20  # ``las_roundtrip`` writes and reads every record once


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("cloudgrain-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_points = points(spark, sf_dir).count()
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times, failed = {}, {}

    def timed(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in wanted:
        try:
            cold = timed(name, small) if os.path.isdir(small) else None
            times[name] = timed(name, sf_dir)
            print(f"{name}: {times[name]} s ({cold} s before, on the smallest tables)", file=sys.stderr, flush=True)
        except Exception as error:  # one failing query must not hide the others' times
            failed[name] = f"{type(error).__name__}: {error}"[:300]
            print(f"{name}: failed, {failed[name]}", file=sys.stderr, flush=True)
    n_bytes = n_points * LAS_RECORD_BYTES
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "points": n_points,
        "rates": {n: round(n_points / t) for n, t in times.items() if t}, "failed": failed,
        "las_mb_per_s": round(2 * n_bytes / 1e6 / times["las_roundtrip"], 1) if times.get("las_roundtrip") else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
