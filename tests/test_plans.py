"""Plans: what is pushed down, what moves, and that hot groups are split."""

import pytest
from pyspark.sql import functions as F

from cloudgrain.operators import grid
from cloudgrain.operators.labels import encode_known_classes
from cloudgrain.plans import ORACLES, QUERIES
from cloudgrain.plans.tables import points
from cloudgrain.schemas import KNOWN_CLASSES

SF = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"knn_chunk", "knn_pyramid", "knn_grid", "nearest_upsample", "gather_neighbours", "relative_encoding", "softmax_pool",
                  "multiscale_features", "las_roundtrip", "external_scoring", "stream_ingest", "stream_scoring", "stream_format", "bad_files", "colocated_upsample"}
MODEL_QUERIES = {"predictions_table", "model_reload", "weighted_rf_counts", "importance_total", "boosted_predictions", "adaptive_trials", "refit_best"}  # building them fits a forest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - PYTHON_QUERIES - MODEL_QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, f"{name}: {word}"


def test_neighbour_joins_are_equi_joins(spark):
    for name in ("knn_grid", "nearest_upsample", "multiscale_features"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    points(spark, SF).write.partitionBy("tile_name").parquet(str(tmp_path / "p"))
    table = spark.read.parquet(str(tmp_path / "p"))
    text = plan(encode_known_classes(table.where("tile_name = 'tile_000.las'")).select("z"))
    assert "PartitionFilters: [isnotnull(tile_name" in text
    assert f"In(classification, [{','.join(map(str, KNOWN_CLASSES))}])" in text
    assert "ReadSchema: struct<z:double,classification:int>" in text


def test_hot_cell_is_split(spark):
    """Beyond the broadcast limit, AQE splits the points of a cell that holds most rows."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(0, 60_000, numPartitions=6).select(
            F.lit("t").alias("tile_name"), F.when(F.col("id") % 3 > 0, F.col("id") % 600 * 2.0).otherwise(0.5).alias("x"), F.lit(0.0).alias("y"),
            (F.col("id") % 100 / 10).alias("z"))
        out = grid.cell_features(df)
        assert out.agg(F.count("z_above_cell_mean")).first()[0] == 60_000
        done = out.groupBy().agg(F.sum("z_cell_range"))
        done.collect()
        assert "skew=true" in plan(done)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_join_sides_do_not_move_points(spark):
    for name in ("density_grid", "coords_encode", "stratified_split", "sample_n_per_group"):
        assert "SortMergeJoin" not in plan(QUERIES[name](spark, SF)), name


def test_ranks_write_counts_only(spark, monkeypatch):
    """Ranking reads the rows again instead of writing them: what is written has one row per (group, range)."""
    from cloudgrain.operators import chunks, ranking, runs

    written, real = [], ranking.settle
    monkeypatch.setattr(ranking, "settle", lambda df: written.append((df.columns, df.count())) or real(df))
    pts = points(spark, SF)
    cut = chunks.assign_chunks(pts, 64, 8)
    assert cut.count() > 5000 and "x_mm" in cut.columns
    sharded = chunks.assign_shard(chunks.chunk_list(cut), 4)
    chunks.assign_batches(sharded, 4).count()
    runs.running_best(pts.withColumnRenamed("point_id", "trial"), loss="z_mm").count()
    assert written and all(set(c) <= {"tile_name", "shard", "_p", "_n", "_base", "_in_group", "_m", "_prev"} for c, _ in written)
    assert max(n for _, n in written) < 500
    plan_text = plan(cut)
    assert plan_text.count("Exchange hashpartitioning") == 1, plan_text


def test_range_bounds_are_literals(spark):
    """The same ranges on every attempt: equal rows get equal numbers whatever the partitioning, nulls first."""
    from cloudgrain.operators.ranking import with_range

    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("g"), F.concat(F.lit("k"), F.col("id")).alias("o"))
    one, two = (with_range(df.repartition(n), ["g"], ["o"], 16) for n in (1, 9))
    assert one.exceptAll(two).count() == 0
    sizes = one.groupBy("_p").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 3 * 5000 / 16 and 12 <= sizes[1] <= 16
    ordered = one.orderBy("g", "o").select("_p").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)


def test_colocated_chunks_are_not_shuffled(spark):
    from cloudgrain.operators import neighbors

    store = QUERIES["colocated_upsample"](spark, "/root/testdata/sf0.01")
    text = plan(store)
    assert "FlatMapCoGroupsInArrow" in text and "Exchange" not in text
    assert store.count() > 0 and neighbors.knn is not None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_fit_rows_are_a_sample_of_the_train_part(spark, sf):
    """Every class gives its share of the bounded rows, however large the table; none of them is a test row."""
    from cloudgrain.operators import learning, sampling
    from cloudgrain.plans import learned

    split = sampling.stratified_split(encode_known_classes(points(spark, f"/root/testdata/{sf}"))).select("point_id", "classification", "split").cache()
    train = split.where("split = 'train'")
    n = train.count()
    fitted = learning.bounded_rows(train, learned.MAX_FIT_ROWS, n)
    share = min(1.0, learned.MAX_FIT_ROWS / n)
    want = {r.classification: r["count"] * share for r in train.groupBy("classification").count().collect()}
    got = {r.classification: r["count"] for r in fitted.groupBy("classification").count().collect()}
    assert all(abs(got[c] - w) <= 4 * (w * (1 - share)) ** 0.5 + 1e-9 for c, w in want.items())
    assert sum(got.values()) >= 0.9 * min(n, learned.MAX_FIT_ROWS)
    split.unpersist()


def test_samples_of_samples_keep_their_share(spark):
    from cloudgrain.operators import sampling

    df = spark.range(40_000).withColumnRenamed("id", "point_id")
    few = sampling.hash_sample(df, 0.2)
    split = sampling.random_split(few).groupBy("split").count().collect()
    assert abs({r.split: r["count"] for r in split}["test"] / few.count() - 0.2) < 0.03
