"""Queries that fit a model. Those whose rows are determined have SQL; the others are checked by property tests.

Models have their full size (forests of 300 trees of depth 8, the whole search space,
all scales); boosting runs ``ROUNDS`` rounds of ``DEPTH`` levels, as each level of a round is a pass over the rows. Models are fitted on all
train rows; statistics, features and scoring cover the whole table too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas, storage
from ..operators import boosting, chunks, grid, labels, learning, sampling
from .registry import query
from .tables import points

MAX_FIT_ROWS = 20_000  # a size for ``learning.bounded_rows``; no query bounds its rows
ROUNDS, DEPTH, RATE = 20, 6, 0.3
_CODES = schemas.KNOWN_CLASSES
_SPLIT = """SELECT point_id, tile_name, classification, CASE WHEN classification = 1 THEN NULL WHEN r <= floor(n*0.2E0+0.5E0) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY classification ORDER BY md5('split:42:' || point_id), point_id) AS r, count(*) OVER (PARTITION BY classification) AS n FROM points) t"""


def _featured(spark, sf) -> DataFrame:
    """All points with their cell features; ``split`` is null where the class is not known."""
    pts = points(spark, sf).drop("predicted_class")
    # Split before the features: the split's passes then read only keys and classes.
    split = sampling.stratified_split(labels.encode_known_classes(pts))
    rest = pts.where(~F.coalesce(F.col("classification").isin(*_CODES), F.lit(False)))
    return grid.cell_features(split.unionByName(rest, allowMissingColumns=True), z="z_mm", unit=1000)


def _train(data: DataFrame) -> DataFrame:
    return data.where("split = 'train'")


def _forest(data: DataFrame, **options):
    return learning.fit_trees(_train(data), codes=_CODES, **options)


def _checked(scored: DataFrame) -> DataFrame:
    """What is determined of scored points: ids, split, actual class, and that a known class is predicted and named."""
    fine = F.col("predicted_class").isin(*_CODES) & F.col("predicted_name").isNotNull()
    return scored.select("point_id", "tile_name", "classification", "split", fine.alias("known_prediction"))


_CHECKED = f"SELECT *, true AS known_prediction FROM ({_SPLIT}) s"


@query("rf_score")
def rf_score(spark, sf):
    data = storage.settle(_featured(spark, sf))
    return learning.score(_forest(data), data).select("point_id", "tile_name", "split", "classification", "predicted_class", "predicted_name", "correct")


@query("predictions_table", _CHECKED)
def predictions_table(spark, sf):
    """Scores of all points written as a table and read back."""
    data = storage.settle(_featured(spark, sf))
    name = f"predictions_{uuid.uuid4().hex}"
    scored = learning.score(_forest(data), data).select("point_id", "split", *schemas.PREDICTION.fieldNames())
    storage.save_table(scored, name, path=f"{storage.work_dir(spark)}/tables/{name}")
    return _checked(spark.table(name))


@query("model_reload", """SELECT count(*) AS n_points, CAST(0 AS BIGINT) AS n_different, true AS same_schema FROM points""")
def model_reload(spark, sf):
    """A saved model, loaded again, gives the same class for every point."""
    data = storage.settle(_featured(spark, sf))
    model = _forest(data)
    path = f"{storage.work_dir(spark)}/models/{uuid.uuid4().hex}"
    learning.save_model(model, path, data)
    loaded, schema = learning.load_model(spark, path)
    one, two = (learning.score(m, data).select("point_id", F.col("predicted_class").alias(n)) for m, n in ((model, "a"), (loaded, "b")))
    return one.join(two, "point_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.count(F.when(F.col("a") != F.col("b"), F.lit(1))).alias("n_different"),
    ).withColumn("same_schema", F.lit(schema == data.select(*schemas.FEATURES).schema))


def _boosted(spark, sf) -> DataFrame:
    data = storage.settle(_featured(spark, sf))
    model = boosting.fit_boosted(_train(data), _CODES, n_estimators=ROUNDS, max_depth=DEPTH, learning_rate=RATE)
    return boosting.score(model, data)


@query("boosted_score")
def boosted_score(spark, sf):
    """All points scored by six-class boosted trees."""
    return _boosted(spark, sf).select("point_id", "tile_name", "split", "classification", "predicted_class", "predicted_name", "correct")


@query("boosted_predictions", _CHECKED)
def boosted_predictions(spark, sf):
    """What is determined of the boosted scores of all points."""
    return _checked(_boosted(spark, sf))


@query("weighted_rf_score")
def weighted_rf_score(spark, sf):
    data = storage.settle(_featured(spark, sf))
    model = learning.fit_trees(learning.with_class_weight(_train(data), of=data), weight="weight", codes=_CODES)
    return learning.score(model, data).groupBy("split", "classification").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


@query("weighted_rf_counts", f"SELECT split, classification, count(*) AS n_points FROM ({_SPLIT}) s GROUP BY ALL")
def weighted_rf_counts(spark, sf):
    """Rows behind each accuracy of the weighted model."""
    return weighted_rf_score(spark, sf).select("split", "classification", "n_points")


@query("feature_importance")
def feature_importance(spark, sf):
    return learning.feature_importance(_forest(storage.settle(_featured(spark, sf))))


@query("importance_total", f"SELECT CAST({len(schemas.FEATURES)} AS BIGINT) AS n_features, 1.0E0 AS total FROM points LIMIT 1")
def importance_total(spark, sf):
    """Importances cover all features and sum to one."""
    return feature_importance(spark, sf).agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 9).alias("total"))


_SPACE = {k: v for k, v in learning.SEARCH_SPACE.items() if k != "learning_rate"}


@query("search_trials")
def search_trials(spark, sf):
    """Five draws from the whole space of what acts on a forest (a learning rate does not)."""
    data = storage.settle(_featured(spark, sf))
    return learning.search(_train(data), data.where("split = 'test'"), _SPACE, n_trials=5, codes=_CODES)


@query("adaptive_trials", f"""SELECT CAST(t AS INT) AS trial, true AS in_space, true AS loss_fits, (SELECT count(*) FROM ({_SPLIT}) s WHERE split = 'test') AS n_judged
  FROM (SELECT unnest(range(0, 7)) AS t) r""")
def adaptive_trials(spark, sf):
    """Seven trials whose parameters come from those before; what is determined of them."""
    data = storage.settle(_featured(spark, sf))
    test = data.where("split = 'test'")
    trials = learning.search(_train(data), test, _SPACE, n_trials=7, adaptive=True, parallelism=2, codes=_CODES)
    inside = F.lit(True)
    for name, (kind, *args) in _SPACE.items():
        inside = inside & (F.col(name).isin(*map(float, args[0])) if kind == "choice" else F.col(name).between(*args))
    return trials.select("trial", inside.alias("in_space"), (F.abs(1 - F.col("accuracy") - F.col("loss")) < 1e-12).alias("loss_fits"), F.lit(test.count()).alias("n_judged"))


@query("refit_best", _CHECKED)
def refit_best(spark, sf):
    """The best trial of a search fitted again and applied to all points; what is determined of its scores."""
    data = storage.settle(_featured(spark, sf))
    train = _train(data)
    trials = learning.search(train, data.where("split = 'test'"), {"max_depth": ("choice", [4, 6, 8, 10]), "n_estimators": ("choice", [20, 50])}, n_trials=3, codes=_CODES)
    return _checked(learning.score(learning.fit_best(train, trials, codes=_CODES), data))


def _chunk_features(spark, sf):
    """Known points in full-size chunks with their features at all scales, and the names of these."""
    known = labels.encode_known_classes(points(spark, sf))
    cut = chunks.assign_chunks(known, schemas.CHUNK_POINTS, schemas.CHUNK_MIN_POINTS, order="morton")
    # Written once: the features and each pass of the split would rank all points anew.
    cut = storage.settle(cut.select("tile_name", "chunk_idx", "pos", "point_id", "x_mm", "y_mm", "z_mm", "z", "intensity", "classification"))
    feats = learning.multiscale_features(cut, stages=schemas.PYRAMID_STAGES + 1, k=schemas.NEIGHBOURS)
    names = [c for c in feats.columns if c[0] == "s" and c[2] == "_"] + ["z", "intensity"]
    split = sampling.stratified_split(cut.select("tile_name", "chunk_idx", "point_id", "z", "intensity", "classification"))
    return storage.settle(split.join(feats, ["tile_name", "chunk_idx", "point_id"])), names


def _accuracy_of(data: DataFrame, fit) -> DataFrame:
    """Accuracy per split; no rows where no tile has points for a chunk."""
    if data.isEmpty():
        scored = data.withColumn("correct", F.lit(None).cast("boolean"))
    else:
        scored = learning.score(fit(_train(data)), data)
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_points"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


@query("chunk_classifier")
def chunk_classifier(spark, sf):
    """Chunks, neighbour graphs at five resolutions, pooled features, forest, held-out accuracy."""
    data, names = _chunk_features(spark, sf)
    return _accuracy_of(data, lambda train: learning.fit_trees(train, names, codes=_CODES))


@query("chunk_network")
def chunk_network(spark, sf):
    """The same features under a multi-layer classifier."""
    data, names = _chunk_features(spark, sf)
    return _accuracy_of(data, lambda train: learning.fit_mlp(train, names, codes=_CODES))
