"""Training, search and scoring of point classifiers with Spark ML."""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize_intensity
from ..schemas import COLSAMPLE, FEATURES, LEARNING_RATE, MAX_DEPTH, N_ESTIMATORS, NEIGHBOURS, SEED, SUBSAMPLE, class_name_of
from ..storage import work_dir
from .chunks import CHUNK, downsample_pyramid
from .metrics import class_weights
from .neighbors import MM, _as_matrix, _nearest, _numeric, _runs, pooled_in_chunk
from .runs import best_trial
from .sampling import hash_sample

# The search space of the tree classifier.
SEARCH_SPACE = {
    "max_depth": ("choice", [4, 6, 8, 10]),
    "learning_rate": ("loguniform", 0.02, 0.3),
    "n_estimators": ("choice", [100, 200, 300, 500]),
    "subsample": ("uniform", 0.6, 1.0),
    "colsample_bytree": ("uniform", 0.5, 1.0),
    "min_child_weight": ("choice", [1, 3, 5, 10]),
    "gamma": ("loguniform", 1e-4, 1.0),
}
_MAX_CLASSES = 256  # a class code is one byte
_FILLED = "_filled_"
_FEW_ROWS, _FEW_PARTS = 1_000_000, 64  # training rows that are spread by cores, and over how many at most
TREES_AT_ONCE, DRAWS_AT_ONCE = 25, 20_000_000  # trees of a forest grown together; more while rows times trees are at most so many


def assemble(df: DataFrame, cols: list[str] = FEATURES, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


@contextmanager
def shared(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a training table for several jobs; memory first, spilling to disk, and freed at the end."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _class_codes(df: DataFrame, label: str) -> list[str]:
    codes = [r[0] for r in df.select(label).distinct().orderBy(label).limit(_MAX_CLASSES + 1).collect()]
    if len(codes) > _MAX_CLASSES:
        raise ValueError(f"{label} has more than {_MAX_CLASSES} values")
    return [str(c) for c in codes]  # numeric order


def bounded_rows(df: DataFrame, max_rows: int, n_rows: int, seed: int = SEED, key: str = "point_id") -> DataFrame:
    """About ``max_rows`` of the ``n_rows`` rows, chosen by a digest of its own, for a first look at a model. The queries fit on all rows."""
    return df if n_rows <= max_rows else hash_sample(df, max_rows / n_rows, seed, key, purpose="fit")


def _fit(
    stages: list, df: DataFrame, features: list[str], label: str, weight: str | None, decoded: str, codes: list[int] | None = None,
) -> PipelineModel:
    codes = [str(c) for c in codes] if codes else _class_codes(df, label)
    keep = [*features, "label"] + ([weight] if weight else [])
    # Nulls become 0 inside the pipeline, so scoring does the same.
    fill = SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(CAST(`{f}` AS double), 0D) AS `{_FILLED}{f}`" for f in features) + " FROM __THIS__")
    # Training passes over its rows many times and each pass lasts as long as its
    # fullest task, so one even spread beforehand pays: few rows over all cores, as their work counts and not
    # their size; of many AQE picks the number of partitions by size.
    indexed = StringIndexerModel.from_labels(codes, label, "label").transform(df).select(*keep)
    cores = min(_FEW_PARTS, df.sparkSession.sparkContext.defaultParallelism)
    indexed = indexed.repartition(cores) if indexed.limit(_FEW_ROWS + 1).count() <= _FEW_ROWS else indexed.hint("rebalance")
    decode = IndexToString(inputCol="prediction", outputCol=decoded, labels=codes)
    with shared(indexed) as rows:
        return Pipeline(stages=[fill, VectorAssembler(inputCols=[_FILLED + f for f in features], outputCol="features"), *stages, decode]).fit(rows)


class _Forest(Estimator):
    """A random forest grown some trees at a time (``TREES_AT_ONCE``, of few rows more), from all rows each.

    Spark keeps, beside every row, how often each tree drew it, and every task sums the statistics of all trees' nodes: 1.2 KB a row and
    up to a GB a task with 300 trees. Trees do not depend on each other, so their number is cut here and not the rows.
    """

    def __init__(self, forest: RandomForestClassifier):
        super().__init__()
        self.forest = forest

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        total, seed = self.forest.getNumTrees(), self.forest.getSeed()
        parts, step = [], max(TREES_AT_ONCE, DRAWS_AT_ONCE // max(dataset.count(), 1))
        for first in range(0, total, step):
            draw = random.Random(f"{seed}:{first}").getrandbits(31) if first else seed
            parts.append(self.forest.copy({self.forest.numTrees: min(step, total - first), self.forest.seed: draw}).fit(dataset))
        if len(parts) == 1:
            return parts[0]
        jvm, gateway = dataset.sparkSession._jvm, dataset.sparkSession.sparkContext._gateway
        kinds = jvm.org.apache.spark.ml.classification
        trees = gateway.new_array(kinds.DecisionTreeClassificationModel, total)
        for i, tree in enumerate(t for part in parts for t in part._java_obj.trees()):
            trees[i] = tree
        whole = kinds.RandomForestClassificationModel(self.forest.uid, trees, parts[0].numFeatures, parts[0].numClasses)
        model = self.forest._copyValues(RandomForestClassificationModel(whole))
        model._transfer_params_to_java()
        return model


def with_class_weight(df: DataFrame, label: str = "classification", out: str = "weight", of: DataFrame | None = None) -> DataFrame:
    """Inverse-frequency weight per row, from the counts of ``of`` (default ``df``); the weight table has one row per known class."""
    w = class_weights(df if of is None else of, label).select(F.col("class_id").alias("_c"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), F.col(label) == F.col("_c")).drop("_c")


def fit_trees(
    df: DataFrame, features: list[str] = FEATURES, label: str = "classification", n_estimators: int = N_ESTIMATORS, max_depth: int = MAX_DEPTH,
    subsample: float = SUBSAMPLE, colsample_bytree: float = COLSAMPLE, min_child_weight: int = 1, gamma: float = 0.0,
    learning_rate: float = LEARNING_RATE, seed: int = SEED, weight: str | None = None, boosted: bool = False, codes: list[int] | None = None,
) -> PipelineModel:
    """Tree classifier for any number of classes; ``codes`` names them, else they are read from ``df`` first.

    A random forest by default; ``boosted`` fits one gradient-boosted model per
    class, as Spark's boosting is binary.
    """
    args = dict(maxDepth=max_depth, subsamplingRate=subsample, minInstancesPerNode=min_child_weight, minInfoGain=gamma,
                featureSubsetStrategy=str(colsample_bytree), seed=seed)
    if boosted:
        tree = OneVsRest(classifier=GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, **args),
                         labelCol="label", featuresCol="features", parallelism=1, **({"weightCol": weight} if weight else {}))
    else:
        # More node statistics per pass: fewer passes over the rows.
        tree = _Forest(RandomForestClassifier(numTrees=n_estimators, labelCol="label", maxMemoryInMB=1024, **args, **({"weightCol": weight} if weight else {})))
    return _fit([tree], df, features, label, weight, "predicted_label", codes)


def fit_mlp(
    df: DataFrame, features: list[str], label: str = "classification", hidden: tuple[int, ...] = (32, 16),
    max_iter: int = 60, seed: int = SEED, codes: list[int] | None = None,
) -> PipelineModel:
    """Multi-layer classifier over standardised features."""
    codes = codes or [int(c) for c in _class_codes(df, label)]
    n_classes = len(codes)
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[len(features), *hidden, n_classes],
                                         maxIter=max_iter, seed=seed)
    return _fit([scale, net], df, features, label, None, "predicted_label", codes)


class _Trees:
    """Nodes of a forest as arrays, children side by side; a leaf is its own child. A batch walks down tree by tree.

    Row by row, every tree would be fetched from memory again for every row: with 300 trees that is most of the time.
    """

    AT_ONCE = 1 << 16  # places of rows in trees that are moved together

    def __init__(self, nodes: pd.DataFrame, n_classes: int):
        nodes = nodes.sort_values(["treeID", "id"], ignore_index=True)
        first = np.searchsorted(nodes["treeID"], np.arange(nodes["treeID"].max() + 1))
        base = first[nodes["treeID"]]
        down, up = (base + nodes[c].to_numpy() for c in ("leftChild", "rightChild"))
        inner = nodes["leftChild"].to_numpy() >= 0
        # Renumbered: roots first, then the children of each inner node as a pair.
        number = np.zeros(len(nodes), np.int64)
        number[first] = np.arange(len(first))
        pair = len(first) + 2 * np.arange(inner.sum())
        number[down[inner]], number[up[inner]] = pair, pair + 1
        self.depth, level = 0, first
        while inner[level].any():
            level = np.concatenate([down[level[inner[level]]], up[level[inner[level]]]])
            self.depth += 1
        self.n_trees, size = len(first), len(nodes)
        self.feature, self.limit = np.zeros(size, np.int64), np.full(size, np.inf)
        self.child, self.votes = np.arange(size), np.zeros((size, n_classes))
        self.feature[number[inner]] = nodes["featureIndex"].to_numpy()[inner]
        self.limit[number[inner]] = nodes["threshold"].to_numpy()[inner]
        self.child[number[inner]] = pair
        counts = np.array(nodes["stats"].tolist(), dtype="f8").reshape(size, n_classes)
        total = np.cumsum(counts, axis=1)[:, -1:]
        self.votes[number] = np.divide(counts, total, out=np.zeros_like(counts), where=total != 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class of every row: votes are added in the order of the trees, the first of equal ones wins."""
        n, out = len(x), np.zeros((len(x), self.votes.shape[1]))
        flat = np.ascontiguousarray(x.T).ravel()
        column, row = self.feature * n, np.arange(n)
        step = max(1, self.AT_ONCE // max(n, 1))
        for lo in range(0, self.n_trees, step):
            at = np.repeat(np.arange(lo, min(lo + step, self.n_trees)), n).reshape(-1, n)
            for _ in range(self.depth):
                # A leaf keeps its place: nothing exceeds its limit.
                at = self.child.take(at) + (flat.take(column.take(at) + row) > self.limit.take(at))
            for tree in at:
                out += self.votes.take(tree, axis=0)
        return out.argmax(axis=1).astype("f8")


def _trees_of(forest: RandomForestClassificationModel) -> _Trees | None:
    """The forest as saved by Spark, its size bounded by trees and depth; None if a split is not a threshold."""
    spark = SparkSession.active()
    path = f"{work_dir(spark)}/models/{uuid.uuid4().hex}"
    forest.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    if not node.where((F.col("leftChild") >= 0) & (F.col("split.numCategories") != -1)).isEmpty():
        return None
    nodes = node.select("treeID", "id", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                        F.col("impurityStats").alias("stats")).toPandas()
    return _Trees(nodes, forest.numClasses)


def _predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform``; the rows of a forest go down its trees in batches."""
    places = [i for i, s in enumerate(model.stages) if isinstance(s, RandomForestClassificationModel)]
    forest = model.stages[places[0]] if len(places) == 1 else None
    trees = _trees_of(forest) if forest is not None and not forest.isDefined("thresholds") else None
    if trees is None:
        return model.transform(df)
    shared_trees = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(shared_trees.value.predict(np.stack(rows.to_numpy())) if len(rows) else np.zeros(0))

    out = PipelineModel(model.stages[:places[0]]).transform(df)
    out = out.withColumn(forest.getPredictionCol(), predict(vector_to_array(forest.getFeaturesCol())))
    return PipelineModel(model.stages[places[0] + 1:]).transform(out)


def score(model: PipelineModel, df: DataFrame, actual: str | None = "classification") -> DataFrame:
    """Predicted class, name and, where the actual class is known, correctness, for the whole table. Map-only."""
    drop = ["features", "scaled", "rawPrediction", "probability", "prediction", "predicted_label"]
    out = _predicted(model, df).withColumn("predicted_class", F.col("predicted_label").cast("int"))
    drop += [c for c in out.columns if c.startswith(_FILLED)]
    out = out.withColumn("predicted_name", class_name_of("predicted_class")).drop(*drop)
    return out.withColumn("correct", F.col("predicted_class") == F.col(actual)) if actual else out


def feature_importance(model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """Importance per feature, largest first (one row per feature, from the fitted model)."""
    tree = next(s for s in model.stages if isinstance(s, OneVsRestModel) or hasattr(s, "featureImportances"))
    if isinstance(tree, OneVsRestModel):
        parts = [m.featureImportances.toArray() for m in tree.models]
        values = sum(parts) / len(parts)
    else:
        values = tree.featureImportances.toArray()
    spark = SparkSession.active()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _draw(rng: random.Random, spec: tuple):
    kind, *args = spec
    if kind == "choice":
        return rng.choice(args[0])
    if kind == "uniform":
        return rng.uniform(*args)
    return math.exp(rng.uniform(*map(math.log, args)))


def sample_space(space: dict, n_trials: int, seed: int = SEED) -> list[dict]:
    """Seeded random draws from the search space."""
    rng = random.Random(seed)
    return [{name: _draw(rng, spec) for name, spec in space.items()} for _ in range(n_trials)]


# Adaptive search: first random trials, share of finished trials that count as good, candidates per draw.
STARTUP, GOOD_SHARE, CANDIDATES = 5, 0.25, 24


def _parzen(spec: tuple, seen: list) -> tuple[Callable[[random.Random], object], Callable[[object], float]]:
    """(draw, log density) around seen values: kernels as wide as the gaps beside them, plus the space itself as one more."""
    kind, *args = spec
    if kind == "choice":
        counts = [1 + seen.count(v) for v in args[0]]
        total = math.log(sum(counts))
        return (lambda rng: rng.choices(args[0], counts)[0]), (lambda v: math.log(counts[args[0].index(v)]) - total)
    to, back = (math.log, math.exp) if kind == "loguniform" else (float, float)
    lo, hi = map(to, args)
    at = sorted(to(v) for v in seen)
    edges = [lo, *at, hi]
    least = (hi - lo) / min(100.0, 1.0 + len(at))
    width = [min(max(edges[i + 1] - edges[i], edges[i + 2] - edges[i + 1], least), hi - lo) for i in range(len(at))]
    centres, widths = [*at, (lo + hi) / 2], [*width, hi - lo]

    def inside(m: float, w: float) -> float:
        return 0.5 * (math.erf((hi - m) / (w * math.sqrt(2))) - math.erf((lo - m) / (w * math.sqrt(2))))

    def draw(rng: random.Random) -> float:
        i = rng.randrange(len(centres))
        while True:
            x = rng.gauss(centres[i], widths[i])
            if lo <= x <= hi:
                return min(max(back(x), args[0]), args[1])

    def log_density(v: float) -> float:
        x = to(v)
        return math.log(sum(math.exp(-0.5 * ((x - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside(m, w)) for m, w in zip(centres, widths)) / len(centres))

    return draw, log_density


def propose(space: dict, finished: list[tuple[dict, float]], number: int, seed: int = SEED) -> dict:
    """Parameters of trial ``number`` given (parameters, loss) of the finished ones.

    The first ``STARTUP`` trials are random. Then finished trials are split into a good share and the rest,
    each described by a Parzen estimate per parameter; of candidates drawn from the good one, the value is taken where good
    is likeliest against the rest, and listed values are drawn in proportion to that. Depends on the seed, the number and the finished trials alone.
    """
    rng = random.Random(f"{seed}:{number}")
    if len(finished) < STARTUP:
        return {name: _draw(rng, spec) for name, spec in space.items()}
    ordered = sorted(finished, key=lambda t: t[1])
    n_good = max(1, math.ceil(GOOD_SHARE * len(ordered)))
    out = {}
    for name, spec in space.items():
        draw, good = _parzen(spec, [p[name] for p, _ in ordered[:n_good]])
        _, rest = _parzen(spec, [p[name] for p, _ in ordered[n_good:]])
        if spec[0] == "choice":
            # By chance in proportion: the best of a few values would always be the same one.
            out[name] = rng.choices(spec[1], [math.exp(good(v) - rest(v)) for v in spec[1]])[0]
        else:
            out[name] = max((draw(rng) for _ in range(CANDIDATES)), key=lambda v: good(v) - rest(v))
    return out


def adaptive_trials(space: dict, objective: Callable[[dict], float], n_trials: int, seed: int = SEED, parallelism: int = 1) -> list[tuple[dict, float]]:
    """(parameters, loss) of every trial, in the order of their numbers.

    Asynchronous: a trial starts as soon as another ends and learns from all that have ended by then. With
    ``parallelism=1`` the trials repeat exactly; with more, what a trial could learn from depends on timing.
    """
    params: list[dict] = []
    loss: dict[int, float] = {}
    running: dict = {}
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        while len(loss) < n_trials:
            while len(params) < n_trials and len(running) < parallelism:
                finished = [(params[i], loss[i]) for i in sorted(loss)]
                params.append(propose(space, finished, len(params), seed))
                running[pool.submit(objective, params[-1])] = len(params) - 1
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for future in done:
                loss[running.pop(future)] = future.result()
    return [(params[i], loss[i]) for i in range(n_trials)]


def search(
    train: DataFrame, test: DataFrame, space: dict | None = None, n_trials: int = 5, seed: int = SEED, parallelism: int = 4,
    features: list[str] = FEATURES, label: str = "classification", adaptive: bool = False, **fixed,
) -> DataFrame:
    """Search minimising 1 - accuracy: one row per trial with its parameters. Random draws, or ``adaptive`` ones (see ``propose``).

    Trials are Spark jobs submitted from a few threads over two shared tables,
    so they fill idle executors; rows never come to the driver.
    """
    space = space or SEARCH_SPACE
    judge = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="_p", metricName="accuracy")
    cols = [*features, label]
    with shared(train.select(*cols)) as tr, shared(test.select(*cols)) as te:

        def loss(params: dict) -> float:
            model = fit_trees(tr, features, label, seed=seed, **{**fixed, **params})
            scored = score(model, te, label).select(F.col(label).cast("double").alias("_y"), F.col("predicted_class").cast("double").alias("_p"))
            return 1.0 - float(judge.evaluate(scored))

        if adaptive:
            trials = adaptive_trials(space, loss, n_trials, seed, parallelism)
        else:
            draws = sample_space(space, n_trials, seed)
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                trials = list(zip(draws, pool.map(loss, draws)))
    rows = [(i, 1.0 - lost, lost, *[float(v) for v in params.values()]) for i, (params, lost) in enumerate(trials)]
    fields = "trial int, accuracy double, loss double" + "".join(f", {p} double" for p in space)
    return train.sparkSession.createDataFrame(rows, fields)


def fit_best(train: DataFrame, trials: DataFrame, features: list[str] = FEATURES, label: str = "classification", **fixed) -> PipelineModel:
    """Fit again with the parameters of the best trial."""
    best = best_trial(trials).first().asDict()
    params = {k: v for k, v in best.items() if k not in {"trial", "accuracy", "loss"}}
    for k in ("max_depth", "n_estimators", "min_child_weight"):
        if k in params:
            params[k] = int(params[k])
    return fit_trees(train, features, label, **{**fixed, **params})


def save_model(model: PipelineModel, path: str, df: DataFrame, features: list[str] = FEATURES) -> None:
    """Save the pipeline with the schema its input has to have."""
    model.write().overwrite().save(f"{path}/pipeline")
    schema = df.select(*features).schema.json()
    df.sparkSession.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, T.StructType]:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return PipelineModel.load(f"{path}/pipeline"), schema


def scoring_udf(load: Callable[[], Callable[[pd.DataFrame], pd.Series]], result: str = "int"):
    """Column function for a model from outside Spark.

    ``load`` runs once per Python worker and returns a function from a batch of
    feature columns to predictions.
    """

    @F.pandas_udf(result)
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch))

    return lambda *cols: predict(F.struct(*cols))


POOLED = ["rel_z", "distance", "intensity"]
_MAX_CHUNK = 16_384  # points of a chunk, as in ``knn``


def multiscale_features(
    chunked: DataFrame, stages: int = 2, k: int = NEIGHBOURS, seed: int = SEED, unit: float = 1000.0,
) -> DataFrame:
    """Neighbourhood features of every point at several resolutions, as ``s<stage>_<name>``.

    Per stage of the pyramid: nearest neighbours, relative encoding, pooling
    with nearer neighbours weighing more. Coarse features come back level by
    level, each time through the nearest point of the next coarser stage. All groups are chunks, and a chunk moves once: its
    stages go to one grouped call on the layout that the pyramid's window made. What is sent grows with the points, not with
    their edges, and nothing is written.

    Rows of one id in a chunk pool their neighbours together, and each of them comes with the coarse features of every other.
    """
    pyramid = downsample_pyramid(chunked, stages - 1, seed=seed)
    rows = _numeric(pyramid.select(*CHUNK, "point_id", *MM, normalize_intensity().alias("_value"), "top_stage"), MM)
    names = [f"s{s}_{c}" for s in range(stages) for c in POOLED]
    schema = T.StructType([rows.schema[c] for c in [*CHUNK, "point_id"]] + [T.StructField(c, T.DoubleType()) for c in names])

    def features(chunk: pa.Table) -> pa.Table:
        if len(chunk) > _MAX_CHUNK:
            raise ValueError(f"a group of {len(chunk)} points exceeds max_group={_MAX_CHUNK}: use knn_grid")
        chunk = chunk.sort_by("point_id")
        m, top = _as_matrix(chunk, MM), chunk.column("top_stage").to_numpy()
        value, named = chunk.column("_value"), chunk.column("point_id").is_valid().to_numpy()
        value, known = value.fill_null(0.0).to_numpy(), value.is_valid().to_numpy()
        run, _, size = _runs(chunk.column("point_id"))
        out, null = np.zeros((len(m), len(names))), np.ones((len(m), len(names)), bool)
        for s in range(stages - 1, -1, -1):
            at, coarse = np.flatnonzero(top >= s), np.flatnonzero((top > s) & named)
            ids, own = np.unique(run[at], return_inverse=True)
            pooled, some = pooled_in_chunk(m[at], own, value[at], known[at], k, unit)
            here, above = slice(s * len(POOLED), (s + 1) * len(POOLED)), slice((s + 1) * len(POOLED), None)
            if len(coarse):
                source = coarse[_nearest(m[at], m[coarse], 1)[1]]
                out[at, above], null[at, above] = out[source, above], null[source, above]
            elif s < stages - 1:
                null[at, above] = True
            out[at, here] = pooled[own]
            null[at, here] = np.column_stack([np.zeros((len(at), len(POOLED) - 1), bool), ~some[own]])
        # Rows without a whole key have no features of their own; they were neighbours of others.
        whole = np.flatnonzero(named & np.logical_and.reduce([chunk.column(c).is_valid().to_numpy() for c in CHUNK]))
        rows_out = np.repeat(whole, size[run[whole]]) if stages > 1 else whole
        keys = [chunk.column(c).take(pa.array(rows_out)) for c in [*CHUNK, "point_id"]]
        return pa.table([*keys, *[pa.array(out[rows_out, i], mask=null[rows_out, i]) for i in range(len(names))]], names=schema.fieldNames())

    return rows.groupBy(*CHUNK).applyInArrow(features, schema)
