"""Single-point, cell, metric and histogram operators on small made-up rows with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from cloudgrain import functions as fx
from cloudgrain.operators import density, grid, labels, metrics, runs, sampling
from cloudgrain.operators.ranking import digest_threshold, rank_within, running_min
from cloudgrain.schemas import POINT, conform, require_columns
from cloudgrain.storage import broadcast_checked


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cells_floor_and_truncation_around_zero(spark):
    df = spark.createDataFrame([(-2.1,), (-2.0,), (-0.5,), (0.0,), (1.999,), (2.0,)], "x double")
    got = df.select(fx.cell_index("x").alias("f"), fx.cell_index("x", mode="trunc").alias("t")).collect()
    assert [r.f for r in got] == [-2, -1, -1, 0, 0, 1]
    assert [r.t for r in got] == [-1, -1, 0, 0, 0, 1]


def test_cell_statistics_of_one_and_two_points(spark):
    rows = [("a", 0.5, 0.5, 1.0, 1000), ("a", 1.0, 1.0, 3.0, 3000), ("a", 5.0, 5.0, 7.0, 7000)]
    df = spark.createDataFrame(rows, "tile_name string, x double, y double, z double, z_mm long")
    for kw in ({}, {"z": "z_mm", "unit": 1000}):
        got = {r.cell_x: r for r in grid.cell_stats(grid.with_cell(df), **kw).collect()}
        assert got[0].z_cell_mean == 2.0 and math.isclose(got[0].z_cell_std, math.sqrt(2)) and got[0].z_cell_range == 2.0
        assert got[2].z_cell_std == 0.0 and got[2].z_cell_range == 0.0
        above = values(grid.cell_features(df, **kw), "z_above_cell_mean")
        assert above == [(-1.0,), (0.0,), (1.0,)]


def test_exact_deviation_survives_huge_sums(spark):
    df = spark.range(1000).select(F.lit("a").alias("tile_name"), F.lit(0).alias("cell_x"), F.lit(0).alias("cell_y"),
                                  (F.lit(2_000_000_000) + F.col("id") % 2).alias("z_mm"))
    r = grid.cell_stats(df, "z_mm", 1000).first()
    assert r.n_points == 1000 and r.z_cell_range == 0.001


def test_labels_in_numeric_order_and_back(spark):
    df = spark.createDataFrame([(10,), (2,), (2,), (9,)], "c int")
    d = labels.fit_labels(df, "c")
    assert values(d, "label", "label_idx") == [(2, 0), (9, 1), (10, 2)]
    back = labels.invert_labels(labels.apply_labels(df, d, "c"), d, out="again")
    assert all(r.c == r.again for r in back.collect())


def test_unknown_class_has_no_name_and_is_dropped_by_encoding(spark):
    df = spark.createDataFrame([(2,), (1,), (9,)], "classification int")
    assert values(labels.with_class_name(df), "classification", "class_name") == [(1, None), (2, "Ground"), (9, "Water")]
    assert values(labels.encode_known_classes(df), "class_idx") == [(0,), (5,)]


def test_scalars(spark):
    r = spark.range(1).select(
        fx.clip(F.lit(70000), 0, 65535).alias("clip"), fx.argmax(F.array(*[F.lit(v) for v in (1, 3, 3)])).alias("arg"),
        fx.log_count(F.lit(0)).alias("log0"), fx.log_count(F.lit(100)).alias("log2"), fx.veg_class(F.lit(4.0)).alias("veg"),
        fx.accuracy_band(F.lit(0.75)).alias("band"), fx.normalize_intensity(F.lit(65535)).alias("one"),
        fx.run_cost(F.lit(3600.0), F.lit(8.0), 0.22).alias("cost")).first()
    assert (r.clip, r.arg, r.log0, r.log2, r.veg, r.band, r.one, r.cost) == (65535, 1, None, 2.0, 4, "medium", 1.0, 1.76)


def test_morton_codes(spark):
    r = spark.range(1).select(fx.interleave2(F.lit(3), F.lit(1)).alias("a"), fx.interleave3(F.lit(1), F.lit(1), F.lit(1)).alias("b"),
                              fx.interleave3(F.lit(2**21 - 1), F.lit(0), F.lit(0)).alias("c")).first()
    assert r.a == 0b0111 and r.b == 7 and r.c == sum(1 << (3 * i) for i in range(21))


def test_not_null_columns_fail_the_job(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 5, 2, "t")], "x double, y double, z double, intensity int, classification int, tile_name string")
    with pytest.raises(Exception, match="NOT NULL column z"):
        conform(df).collect()
    assert require_columns(conform(df), POINT) is not None
    with pytest.raises(ValueError, match="missing"):
        require_columns(df.drop("x"), POINT)


def test_encode_rounds_half_even(spark):
    df = spark.createDataFrame([("t", 0.0005, 0.0, 0.0), ("t", 0.0015, 0.0, 0.0)], "tile_name string, x double, y double, z double")
    offs = spark.createDataFrame([("t", 0.0, 0.0, 0.0)], "tile_name string, off_x double, off_y double, off_z double")
    assert values(grid.encode_coords(df, offs, 0.001), "xi") == [(0,), (2,)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "v double")
    got = density.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r.n for r in got] == [2, 2, 0, 0, 1] and got[0].bin_lo == 0.0 and got[-1].bin_hi == 10.0
    flat = density.histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [(r.bin_lo, r.n) for r in flat] == [(3.5, 0), (4.0, 2)]


def test_height_histogram_drops_small_class_and_outside_points(spark):
    rows = [(2, 0.0)] * 9 + [(2, 30.0), (2, 31.0)] + [(3, 1.0)] * 9
    df = spark.createDataFrame(rows, "classification int, z double")
    got = density.height_histogram(df).orderBy("bin").collect()
    assert [(r.classification, r.bin, r.n_points) for r in got] == [(2, 3, 9), (2, 99, 1)]
    assert math.isclose(sum(r.density for r in got) * 0.31, 1.0)


def test_report_of_class_never_predicted(spark):
    rows = [(2, 2), (2, 2), (3, 2), (9, 9)]
    df = spark.createDataFrame(rows, "classification int, predicted_class int")
    got = {r.label: r for r in metrics.classification_report(df, labels=[2, 3, 9]).collect()}
    assert got["LowVeg"].precision == 0.0 and got["LowVeg"].f1 == 0.0 and got["Ground"].recall == 1.0
    assert math.isclose(got["Ground"].precision, 2 / 3) and got["accuracy"].f1 == 0.75 and got["accuracy"].support == 4
    share = metrics.confusion_matrix(df, normalize="row").where("actual = 5").collect()
    assert len(share) == 6 and all(r.n == 0 and r.share is None for r in share)


def test_weights_of_skewed_classes(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 6).otherwise(2).alias("classification"))
    w = {r.class_id: r.weight for r in metrics.class_weights(df).collect()}
    assert math.isclose(sum(w.values()), 6.0) and w[2] > w[6] and math.isclose(w[3] / w[6], 901.0)


def test_stratified_split_of_hot_class(spark):
    df = spark.range(5000).select(F.col("id").alias("point_id"), F.when(F.col("id") % 10 < 9, 6).otherwise(2).alias("classification"))
    out = sampling.stratified_split(df)
    assert values(out.where("split = 'test'").groupBy("classification").count(), "classification", "count") == [(2, 100), (6, 900)]
    assert out.count() == 5000
    again = sampling.stratified_split(df.repartition(7)).where("split = 'test'").select("point_id")
    assert again.exceptAll(out.where("split = 'test'").select("point_id")).count() == 0


def test_threshold_refines_a_large_bucket(spark):
    df = spark.range(4000).select(F.col("id").alias("point_id"), F.lit(1).alias("g"))
    coarse = digest_threshold(df, ["g"], F.lit(1234), ["point_id"], 42).first()
    fine = digest_threshold(df, ["g"], F.lit(1234), ["point_id"], 42, digits=1, max_bucket=5).first()
    assert (coarse._thr, coarse._thr_id) == (fine._thr, fine._thr_id)
    assert df.where(fx.digest(42, "point_id") <= coarse._thr).count() == 1234


def test_sample_per_group_keeps_small_groups_and_null_keys(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else ("b" if i < 53 else None)) for i in range(60)], "point_id long, t string")
    got = sampling.sample_n_per_group(df, ["t"], 5).groupBy("t").count().collect()
    assert {(r.t, r["count"]) for r in got} == {("a", 5), ("b", 3), (None, 5)}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_rank_and_running_minimum_over_partitions(spark, parts):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("g"),
                                  ((F.col("id") * 7919) % 1000).alias("v"))
    got = rank_within(df, ["g"], ["id"], "rn", total="n", partitions=parts).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.id):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.rn == seen[r.g] and r.n == (800 if r.g == "hot" else 200)
    low = math.inf
    for r in sorted(running_min(df, [], ["id"], "v", "m", parts).collect(), key=lambda r: r.id):
        low = min(low, r.v)
        assert r.m == low


def test_broadcast_hint_only_below_limit(spark):
    small, large = broadcast_checked(spark.range(5), 5), broadcast_checked(spark.range(6), 5)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small).lower() and "broadcast" not in plan(large).lower()


def test_trial_tables(spark):
    t = spark.createDataFrame([(0, 0.5, "a", 10.0), (1, 0.2, "b", 0.0), (2, 0.2, "z", 5.0)], "trial int, loss double, run_name string, elapsed_s double")
    assert runs.best_trial(t).first().trial == 1
    m = spark.createDataFrame([("a", 0.9)], "run_name string, acc double")
    assert values(runs.attach_metrics(t, m, ["acc"]), "trial", "acc") == [(0, 0.9), (1, 0.0), (2, 0.0)]
    assert values(runs.speedup(t, "a", "run_name"), "trial", "speedup") == [(0, 1.0), (1, 0.0), (2, 2.0)]
    setups = spark.createDataFrame([("a", 2.0), ("c", 8.0)], "run_name string, units_per_hour double")
    log = spark.createDataFrame([("a", "elapsed_s", 3600.0), ("a", "final_acc", 0.9)], "run_name string, key string, value double")
    assert values(runs.compare_setups(setups, log), "run_name", "final_acc", "cost") == [("a", 0.9, 0.44), ("c", None, None)]
    binned = runs.param_importance(t, ["elapsed_s"], bins=2).first()
    assert 0.0 <= binned.importance <= 1.0
    assert runs.param_grid(spark, lr=[1, 2], batch=[2, 4]).count() == 4


def test_report_counts_unknown_predictions_as_misses(spark):
    df = spark.createDataFrame([(2, 2)] * 6 + [(2, 1)] * 3 + [(2, None)] + [(3, 3)] * 5 + [(1, 2)] * 4, "classification int, predicted_class int")
    got = {r.label: r for r in metrics.classification_report(df).collect()}
    assert got["Ground"].recall == 0.6 and got["Ground"].support == 10 and got["Ground"].precision == 1.0
    assert got["accuracy"].support == 15 and abs(got["accuracy"].recall - 11 / 15) < 1e-12
    cm = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(df, other=-1).collect()}
    assert cm[2, -1] == 4 and len(cm) == 42
    wide = metrics.confusion_matrix(df, shape="wide", other=-1)
    assert "pred_other" in wide.columns and wide.where("actual = 2").first().pred_other == 4
    assert sum(r.n for r in metrics.confusion_matrix(df).collect()) == 11


def test_cells_of_points_without_a_tile(spark):
    """A null tile is a tile like others: its points keep their statistics and offsets."""
    df = spark.createDataFrame([(None, 0.5, 0.5, 1.0), (None, 0.6, 0.4, 3.0), ("t", 0.5, 0.5, 9.0)], "tile_name string, x double, y double, z double")
    got = {(r.tile_name, r.z): (r.z_cell_mean, r.z_above_cell_mean) for r in grid.cell_features(df).collect()}
    assert got == {(None, 1.0): (2.0, -1.0), (None, 3.0): (2.0, 1.0), ("t", 9.0): (9.0, 0.0)}
    assert grid.encode_coords(df).where("xi IS NULL").count() == 0
