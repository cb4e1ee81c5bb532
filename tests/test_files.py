"""Scan files, tables and streams."""

import os
import struct
import tempfile
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudgrain.operators.grid import cell_features
from cloudgrain.schemas import POINT
from cloudgrain.sources import las
from cloudgrain.storage import discard, load_chunks, save_chunks, save_table, settle, table_or, work_dir
from cloudgrain.streaming import tiles


def some_points(spark, n=1000, n_tiles=3):
    return spark.range(n).select(
        (F.col("id") % 97 / 10.0 - 4).alias("x"), (F.col("id") % 89 / 10.0).alias("y"), (F.col("id") % 13 / 8.0).alias("z"),
        (F.col("id") % 65536).cast("int").alias("intensity"), (F.col("id") % 7 + 2).cast("int").alias("classification"),
        F.concat(F.lit("tile_"), (F.col("id") % n_tiles).cast("string"), F.lit(".las")).alias("tile_name"))


def rows(df):
    return sorted((r.tile_name, round(r.x, 3), round(r.y, 3), round(r.z, 3), r.intensity, r.classification) for r in df.collect())


@pytest.mark.parametrize("step", [7, 2_000_000])
def test_round_trip(spark, tmp_path, step):
    df, path = some_points(spark), str(tmp_path / "t")
    las.save_las(df, path)
    assert sorted(os.listdir(path)) == ["tile_0.las", "tile_1.las", "tile_2.las"]
    assert os.listdir(f"{path}/tile_0.las") == ["part-00000.las"] and os.path.getsize(f"{path}/tile_0.las/part-00000.las") == 227 + 20 * 334
    back = las.read_las(spark, path, records_per_range=step)
    assert rows(back) == rows(df) and back.columns == POINT.fieldNames()
    assert rows(spark.read.format("las").option("recordsPerPartition", step).load(path)) == rows(df)
    one = spark.read.format("las").load(path).where("tile_name = 'tile_1.las'")
    assert rows(one) == rows(df.where("tile_name = 'tile_1.las'"))
    assert rows(las.read_las(spark, path, tiles=["tile_2.las"])) == rows(df.where("tile_name = 'tile_2.las'"))


def test_big_tile_becomes_a_folder_and_overwrite_clears_stale_files(spark, tmp_path):
    df, path = some_points(spark, 900, 2), str(tmp_path / "t")
    las.save_las(df, path, points_per_file=100)
    assert os.path.isdir(f"{path}/tile_0.las") and len(os.listdir(f"{path}/tile_0.las")) > 1
    assert rows(las.read_las(spark, path)) == rows(df)
    las.save_las(df.where("tile_name = 'tile_1.las'"), str(tmp_path / "u"))
    las.save_las(df.where("tile_name = 'tile_0.las'"), str(tmp_path / "u"))
    assert [f for f in os.listdir(tmp_path / "u") if not f.startswith("_")] == ["tile_0.las"]


def test_record_numbers(spark, tmp_path):
    las.save_las(some_points(spark), str(tmp_path / "t"))
    got = las.read_las(spark, str(tmp_path / "t"), records_per_range=50, record_no=True)
    assert got.select("tile_name", "record_no").distinct().count() == 1000


def padded(data: bytes) -> bytes:
    """The same file as written with two text fields one byte too long."""
    return data[:58] + b"\0" + data[58:90] + b"\0" + data[90:]


def one_tile() -> bytes:
    n = 5
    t = pa.table({"x": np.arange(n) * 1.0, "y": np.arange(n) * 2.0, "z": np.arange(n) * 0.5,
                  "intensity": pa.array([1, 2, 3, 4, 65535], pa.int32()), "classification": pa.array([2, 3, 4, 5, 255], pa.int32())})
    return las.encode_tile(t)


def test_both_header_layouts_and_bad_files(spark, tmp_path):
    good = one_tile()
    (tmp_path / "a.las").write_bytes(good)
    (tmp_path / "b.las").write_bytes(padded(good))
    both = las.read_las(spark, str(tmp_path)).orderBy("tile_name", "x").collect()
    assert [r.x for r in both] == [0.0, 1.0, 2.0, 3.0, 4.0] * 2 and both[-1].intensity == 65535 and both[-1].classification == 255
    assert struct.unpack_from("<I", good, 107)[0] == 5
    (tmp_path / "cut.las").write_bytes(good[:-3])
    (tmp_path / "not.las").write_bytes(b"NOPE" + good[4:])
    (tmp_path / "empty.las").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    with pytest.raises(Exception, match="LAS file|disagree"):
        las.read_las(spark, str(tmp_path)).collect()
    assert las.read_las(spark, str(tmp_path), "DROPMALFORMED").count() == 10
    bad = las.read_las(spark, str(tmp_path), "PERMISSIVE").where("_corrupt is not null")
    assert {r.tile_name for r in bad.collect()} == {"cut.las", "not.las"}  # a file of no bytes has no points
    assert spark.read.format("las").option("mode", "DROPMALFORMED").load(str(tmp_path)).count() == 10


def test_extra_record_bytes(spark, tmp_path):
    good = bytearray(one_tile())
    head, body = good[:227], good[227:]
    struct.pack_into("<BH", head, 104, 1, 28)
    (tmp_path / "a.las").write_bytes(bytes(head) + b"".join(bytes(body[i:i + 20]) + b"\1" * 8 for i in range(0, 100, 20)))
    assert [r.x for r in las.read_las(spark, str(tmp_path)).orderBy("x").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_tables(spark, tmp_path):
    df = some_points(spark, 50)
    save_table(df, "pc_test_points", path=str(tmp_path / "p"))
    save_table(df.withColumn("extra", F.lit(1)), "pc_test_points", ["tile_name"], str(tmp_path / "p"))
    assert "extra" in spark.table("pc_test_points").columns and spark.table("pc_test_points").count() == 50
    assert table_or(spark, "pc_test_points", lambda: None).count() == 50
    assert table_or(spark, "pc_test_absent", lambda: spark.range(3)).count() == 3
    spark.sql("DROP TABLE pc_test_points")


def test_chunk_store_replaces_old_tiles(spark, tmp_path):
    path = str(tmp_path / "c")
    save_chunks(some_points(spark, 60), path)
    save_chunks(some_points(spark, 60).where("tile_name = 'tile_1.las'"), path)
    assert {r.tile_name for r in load_chunks(spark, path).select("tile_name").distinct().collect()} == {"tile_1.las"}


def test_settled_rows_are_written_below_the_work_folder(spark):
    df = settle(spark.range(10).withColumn("a", F.array("id")))
    assert df.count() == 10 and all(urlparse(work_dir(spark)).path in f for f in df.inputFiles())
    discard(df)
    assert not any(os.path.exists(urlparse(f).path) for f in df.inputFiles())


def test_checkpoint_dir_of_the_session_comes_first(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "own"))
    try:
        assert str(tmp_path / "own") in work_dir(spark)
    finally:
        spark.sparkContext._jsc.sc().setCheckpointDir(tempfile.mkdtemp())


def test_scan_file_refuses_what_it_cannot_hold(spark, tmp_path):
    good = some_points(spark, 10, 1)
    for name, value in (("intensity", 70_000), ("intensity", -1), ("classification", 300), ("x", float("nan")), ("z", 5e6), ("y", None)):
        bad = good.withColumn(name, F.when(F.col("x") > 0, F.col(name)).otherwise(F.lit(value).cast(good.schema[name].dataType)))
        with pytest.raises(Exception, match="fit the scan file|is null"):
            las.save_las(bad, str(tmp_path / "t"))
    assert not os.path.exists(tmp_path / "t") or not [f for f in os.listdir(tmp_path / "t") if f.endswith(".las")]


def test_one_layout_at_every_size(spark, tmp_path):
    """The same coordinates, bit by bit, whether a tile is one file or many, and in order."""
    df = some_points(spark, 600, 2)
    las.save_las(df, str(tmp_path / "a"))
    las.save_las(df, str(tmp_path / "b"), points_per_file=50)
    a, b = (sorted(map(tuple, las.read_las(spark, str(tmp_path / x)).collect())) for x in "ab")
    assert a == b and len(os.listdir(tmp_path / "b" / "tile_0.las")) == 6
    first = las.read_las(spark, str(tmp_path / "a"), record_no=True).where("tile_name = 'tile_0.las'").orderBy("record_no").collect()
    assert [(r.x, r.y) for r in first] == sorted((r.x, r.y) for r in first)


def test_runs_are_cut_at_the_ends_of_files(spark, tmp_path, monkeypatch):
    """Points are sorted and encoded where they lie in runs; files take them whole or in part, in order, and their headers say what they hold."""
    monkeypatch.setattr(las, "RUN", 64)
    moved, real = [], las._runs
    monkeypatch.setattr(las, "_runs", lambda *a: moved.append(settle(real(*a))) or moved[-1])
    df, path = some_points(spark, 1000, 2), str(tmp_path / "t")
    las.save_las(df, path, points_per_file=150)
    sizes = [r.n for r in moved[0].select("n").collect()]
    assert sum(sizes) == 1000 and 1 < max(sizes) <= 64 and len(os.listdir(f"{path}/tile_0.las")) == 4
    back = las.read_las(spark, path, record_no=True)
    assert rows(back.drop("record_no")) == rows(df)
    for tile in ("tile_0.las", "tile_1.las"):
        order = [(round(r.x, 3), round(r.y, 3)) for part in sorted(os.listdir(f"{path}/{tile}")) for r in las.read_las(spark, f"{path}/{tile}/{part}", record_no=True).orderBy("record_no").collect()]
        assert order == sorted(order) and len(order) == 500
        for part in os.listdir(f"{path}/{tile}"):
            with open(f"{path}/{tile}/{part}", "rb") as f:
                box = struct.unpack_from("<6d", f.read(227), las.AT_OFFSET + 24)
            held = las.read_las(spark, f"{path}/{tile}/{part}").agg(*[g(c) for c in "xyz" for g in (F.max, F.min)]).first()
            assert box == pytest.approx(tuple(held), abs=1e-9)


def test_stream_reads_each_file_once_and_survives_restart(spark, tmp_path):
    df, src = some_points(spark), str(tmp_path / "src")
    las.save_las(df.where("tile_name <> 'tile_2.las'"), src)
    run = lambda: tiles.ingest(tiles.stream_las(spark, src, 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    las.save_las(df.where("tile_name = 'tile_2.las'"), src, mode="append")
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(df)


def test_scoring_replaces_whole_tiles(spark, tmp_path):
    df, src, out = some_points(spark, 600, 2), str(tmp_path / "src"), str(tmp_path / "out")
    scorer = lambda p: cell_features(p).withColumn("predicted_class", F.lit(2))

    def run(cp):
        tiles.score_new_tiles(spark, src, scorer, out, str(tmp_path / cp), files_per_batch=1).awaitTermination()

    las.save_las(df, src, points_per_file=100)  # tiles of several files, one file per batch
    run("cp")
    run("replay")  # everything again from a fresh checkpoint: same table
    assert rows(spark.read.parquet(out)) == rows(df)
    whole = {(r.tile_name, r.cell_x, r.cell_y): r.z_cell_range for r in cell_features(las.read_las(spark, src)).collect()}
    for r in spark.read.parquet(out).collect():
        assert abs(r.z_cell_range - whole[(r.tile_name, r.cell_x, r.cell_y)]) < 1e-9


def test_running_accuracy_in_update_mode_equals_batch(spark, tmp_path):
    df = some_points(spark).withColumn("correct", F.col("classification") % 2 == 0).select("tile_name", "correct")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (tiles.running_accuracy(feed, ["tile_name"]).writeStream.outputMode("update").format("memory").queryName("running_acc")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = spark.table("running_acc").groupBy("tile_name").agg(F.max_by(F.struct("n_points", "n_correct"), "n_points").alias("r")).select("tile_name", "r.*")
    want = tiles.running_accuracy(df, ["tile_name"]).drop("accuracy")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_stream_format_survives_restart(spark, tmp_path):
    """Files of the second run are read once, those of the first not again; a run without new files writes nothing."""
    las.register(spark)
    df, src = some_points(spark), str(tmp_path / "src")

    def run():
        feed = spark.readStream.format("las").load(src)
        tiles.ingest(feed, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    las.save_las(df.where("tile_name = 'tile_0.las'"), src)
    assert rows(run()) == rows(df.where("tile_name = 'tile_0.las'"))
    las.save_las(df.where("tile_name <> 'tile_0.las'"), src, points_per_file=100, mode="append")
    assert rows(run()) == rows(df)
    assert rows(run()) == rows(df)


def test_stream_offsets_of_the_format(tmp_path):
    reader = las._StreamReader({"path": str(tmp_path)})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    for k, name in enumerate(("b.las", "a.las", "c.las")):
        (tmp_path / name).write_bytes(one_tile())
        os.utime(tmp_path / name, ns=(10**18 + (k > 1), 10**18 + (k > 1)))
    first = {"time": 10**18, "path": str(tmp_path / "a.las")}
    names = lambda a, b: [os.path.basename(r.path) for r in reader.partitions(a, b)]
    end = reader.latestOffset()
    assert os.path.basename(end["path"]) == "c.las"
    assert names(reader.initialOffset(), end) == ["a.las", "b.las", "c.las"] and names(first, end) == ["b.las", "c.las"] and names(end, end) == []


def test_scoring_lists_touched_tiles_only(spark, tmp_path, monkeypatch):
    df, src = some_points(spark, 300, 3), str(tmp_path / "src")
    las.save_las(df, src, points_per_file=40)
    asked, real = [], tiles.list_files
    monkeypatch.setattr(tiles, "list_files", lambda s, paths: asked.append(sorted(os.path.basename(p) for p in paths)) or real(s, paths))
    scorer = lambda p: p.withColumn("predicted_class", F.lit(2))
    run = lambda: tiles.score_new_tiles(spark, src, scorer, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    las.save_las(some_points(spark, 30, 1).withColumn("tile_name", F.lit("tile_9.las")), src, mode="append")
    run()
    assert asked == [["tile_0.las", "tile_1.las", "tile_2.las"], ["tile_9.las"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 330


@pytest.mark.parametrize("seed", [1, 2])
def test_cell_states_add_up_in_any_order(spark, tmp_path, seed):
    from cloudgrain.operators import grid

    df = some_points(spark, 2000).withColumn("z_mm", F.when(F.col("classification") > 2, (F.col("z") * 1000).cast("long")))
    df.orderBy(F.rand(seed)).repartition(6).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tiles.update_cells(feed, str(tmp_path / "cells"), str(tmp_path / "cp"), "z_mm").awaitTermination()
    tiles.update_cells(feed, str(tmp_path / "cells"), str(tmp_path / "replay"), "z_mm").awaitTermination()  # every batch once more
    got = tiles.read_cells(spark, str(tmp_path / "cells"), 1000)
    want = grid.cell_stats(grid.with_cell(df), "z_mm", 1000)
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_changes_are_written_per_touched_group(spark, tmp_path):
    df = some_points(spark, 900).withColumn("correct", F.col("classification") % 2 == 0).select("tile_name", "correct")
    for k, part in enumerate(("tile_0.las", "tile_1.las", "tile_0.las")):
        df.where(F.col("tile_name") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    tiles.keep_changes(tiles.running_accuracy(feed, ["tile_name"]), out, str(tmp_path / "cp")).awaitTermination()
    written = spark.read.parquet(out).groupBy("batch").count().collect()
    assert len(written) >= 3 and all(r["count"] <= 1 for r in written)  # one tile a batch
    whole = spark.read.parquet(str(tmp_path / "in"))
    got, want = tiles.read_changes(spark, out, ["tile_name"]), tiles.running_accuracy(whole, ["tile_name"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_log_replaces_repeated_rows(spark, tmp_path):
    from cloudgrain.operators import runs

    path = str(tmp_path / "log")
    schema = "run_id long, run_name string, key string, step int, value double"
    some = spark.createDataFrame([(1, "a", "loss", 0, 0.5), (1, "a", "loss", 1, 0.4), (2, "a", "loss", 0, 0.9), (2, "b", "acc", None, 0.1)], schema)
    runs.log_metrics(some, path)
    once = sorted(map(tuple, runs.read_log(spark, path).collect()), key=str)
    runs.log_metrics(some, path)
    assert sorted(map(tuple, runs.read_log(spark, path).collect()), key=str) == once == sorted(map(tuple, some.collect()), key=str)
    runs.log_metrics(spark.createDataFrame([(1, "a", "loss", 1, 0.3), (1, "a", "loss", 2, 0.2)], schema), path)
    log = {(r.run_id, r.key, r.step): r.value for r in runs.read_log(spark, path).collect()}
    assert log[1, "loss", 1] == 0.3 and log[1, "loss", 2] == 0.2 and len(log) == 5
    runs.compact_log(spark, path, str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 5


def test_declared_schema_fails_on_a_null(spark):
    from cloudgrain.schemas import conform

    df = some_points(spark, 20)
    assert conform(df.withColumn("extra", F.lit(1))).columns == POINT.fieldNames()
    with pytest.raises(Exception, match="null in NOT NULL column z"):
        conform(df.withColumn("z", F.when(F.col("x") > 0, F.col("z")))).collect()
