"""Fitting, search, persistence and external scoring."""

import pytest
from pyspark.sql import functions as F

from cloudgrain.operators import learning as lr
from cloudgrain.schemas import require_columns

FEATS = ["x", "z"]


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(1200).select(
        F.col("id").alias("point_id"), (F.col("id") % 31).cast("double").alias("x"), (F.col("id") % 6 + (F.col("id") % 10) / 20).alias("z"),
        F.element_at(F.array(*[F.lit(c) for c in (2, 3, 4, 5, 6, 9)]), (F.col("id") % 6 + 1).cast("int")).alias("classification")).cache()


def accuracy(df):
    return df.agg(F.avg(F.col("correct").cast("int"))).first()[0]


def test_forest_importance_and_repeatability(spark, data):
    model = lr.fit_trees(data, FEATS, n_estimators=5, max_depth=4)
    out = lr.score(model, data)
    assert accuracy(out) > 0.9 and out.where("correct and predicted_name is null").count() == 0
    imp = lr.feature_importance(model, FEATS).collect()
    assert imp[0].feature == "z" and imp[0].importance >= imp[1].importance
    again = lr.score(lr.fit_trees(data, FEATS, n_estimators=5, max_depth=4), data)
    assert again.select("point_id", "predicted_class").exceptAll(out.select("point_id", "predicted_class")).count() == 0


def test_boosted_and_weighted(spark, data):
    few = data.where("classification in (2, 3)")
    model = lr.fit_trees(few, FEATS, n_estimators=3, max_depth=3, boosted=True)
    assert accuracy(lr.score(model, few)) > 0.9
    assert lr.feature_importance(model, FEATS).first().feature == "z"
    weighted = lr.with_class_weight(data)
    assert weighted.count() == data.count()
    assert accuracy(lr.score(lr.fit_trees(weighted, FEATS, n_estimators=5, max_depth=4, weight="weight"), data)) > 0.9


def test_search_refit_save_load(spark, data, tmp_path):
    space = {"max_depth": ("choice", [2, 4]), "n_estimators": ("choice", [3]), "gamma": ("loguniform", 1e-4, 1e-2)}
    trials = lr.search(data, data, space, n_trials=3, features=FEATS)
    assert trials.count() == 3 and {"trial", "accuracy", "loss", "max_depth", "gamma"} <= set(trials.columns)
    assert lr.sample_space(space, 3) == lr.sample_space(space, 3)
    model = lr.fit_best(data, trials, FEATS)
    lr.save_model(model, str(tmp_path / "m"), data, FEATS)
    loaded, schema = lr.load_model(spark, str(tmp_path / "m"))
    require_columns(data, schema)
    with pytest.raises(ValueError):
        require_columns(data.withColumn("z", F.col("z").cast("string")), schema)
    a, b = (lr.score(m, data).select("point_id", "predicted_class") for m in (model, loaded))
    assert a.exceptAll(b).count() == 0


def test_network(spark, data):
    assert accuracy(lr.score(lr.fit_mlp(data, FEATS, hidden=(8,), max_iter=80), data)) > 0.5


def test_external_model(spark, data):
    out = data.select("z", lr.scoring_udf(lambda: lambda b: (b["z"] > 3).astype("int32"))("z").alias("p"))
    assert out.where("p <> cast(z > 3 as int)").count() == 0


def test_training_table_is_released(spark, data):
    with lr.shared(data.select("x")) as kept:
        assert kept.is_cached
    assert not kept.is_cached


def test_files_to_report(spark, tmp_path):
    """The README example: scan files, features, split, forest, report."""
    from cloudgrain.operators import grid, labels, metrics, sampling
    from cloudgrain.sources.las import read_las, save_las

    made = spark.range(3000).select(
        (F.col("id") % 50 / 5.0).alias("x"), (F.col("id") % 47 / 5.0).alias("y"), (F.col("id") % 6 * 2.0).alias("z"),
        F.lit(7).alias("intensity"), F.element_at(F.array(*[F.lit(c) for c in (2, 3, 4, 5, 6, 1)]), (F.col("id") % 6 + 1).cast("int")).alias("classification"),
        F.concat(F.lit("tile_"), (F.col("id") % 3).cast("string"), F.lit(".las")).alias("tile_name"))
    save_las(made, str(tmp_path / "tiles"))
    points = labels.encode_known_classes(read_las(spark, str(tmp_path / "tiles"), record_no=True))
    points = points.selectExpr("*", "tile_name || ':' || record_no AS point_id")
    data = grid.cell_features(sampling.stratified_split(points))
    model = lr.fit_trees(data.where("split = 'train'"), n_estimators=5, max_depth=5)
    report = {r.label: r for r in metrics.classification_report(lr.score(model, data.where("split = 'test'"))).collect()}
    assert report["accuracy"].support == 500 and report["accuracy"].f1 > 0.9
