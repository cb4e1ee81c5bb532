"""Gradient boosting for many classes at once, over histograms that Spark adds up.

Features are cut into bins by exact quantiles of all rows. A round grows one tree per class of the softmax loss,
all of them level by level: every task sums gradients and hessians per (class, node, feature, bin) of its
rows, the sums of one (class, node, feature) meet in a task, and only its best split comes to the driver. So
a level costs one pass over the rows and a shuffle whose size does not depend on their number. Scores of
finished rounds are written every ``KEEP`` rounds; between, they are computed again from the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COLSAMPLE, FEATURES, LEARNING_RATE, MAX_DEPTH, N_ESTIMATORS, SEED, SUBSAMPLE, class_name_of
from ..storage import discard, settle

BINS = 64
KEEP = 2
BLOCK = 4096  # rows that go down the trees together
_ALL = 256  # a cut that no bin is beyond
_LEAST_HESSIAN, _LEAST_GAIN = 1e-16, 1e-9
_LIMIT = 1 << 30


@dataclass
class Tree:
    """A tree as a heap: node i has children 2i+1 (bin at most ``cut``) and 2i+2. ``feature`` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def root(cls, depth: int) -> Tree:
        size = (1 << (depth + 1)) - 1
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row of (rows, features) bins."""
        inner = self.feature >= 0
        place = np.arange(len(inner))
        # A leaf leads to itself: no bin is beyond its cut.
        feature, cut, below = np.maximum(self.feature, 0).astype(np.intp), np.where(inner, self.cut, _ALL), np.where(inner, 2 * place + 1, place)
        node, first, flat = np.zeros(len(bins), np.intp), np.arange(len(bins)) * bins.shape[1], np.ascontiguousarray(bins).ravel()
        for _ in range(int(np.flatnonzero(inner)[-1] + 1).bit_length() if inner.any() else 0):
            node = below.take(node) + (flat.take(first + feature.take(node)) > cut.take(node))
        return node

    def filled(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, features, cuts, values) with leaves carried down to the depth that is reached: every row takes as many steps, without a test for leaves."""
        feature, cut, value = np.maximum(self.feature, 0).astype(np.intp), self.cut.copy(), self.value.copy()
        inner = np.flatnonzero(self.feature >= 0)
        depth = int(inner[-1] + 1).bit_length() if len(inner) else 0
        for node in range((1 << depth) - 1):
            if self.feature[node] < 0 or node and cut[node] == _ALL:
                cut[node] = cut[2 * node + 1] = _ALL
                value[2 * node + 1] = value[node]
        return depth, feature, cut, value


@dataclass
class Booster:
    """Edges of each feature's bins, and one list of trees (by class) per round."""

    features: list[str]
    codes: list[int]
    edges: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def bins(self, matrix: np.ndarray) -> np.ndarray:
        """Bin of every value; a missing one counts as 0, as in the other tree models."""
        matrix = np.nan_to_num(matrix, nan=0.0)
        return np.column_stack([np.searchsorted(e, matrix[:, i]) for i, e in enumerate(self.edges)]).astype(np.uint8)

    def since(self, turn: int) -> Booster:
        """The same with the rounds from ``turn`` on alone: what tasks need beside written scores."""
        return Booster(self.features, self.codes, self.edges, self.start, self.rounds[turn:])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the trees' values per class."""
        out = np.zeros((len(self.codes), len(bins)))
        full = [[tree.filled() for tree in trees] for trees in self.rounds]
        flat = np.ascontiguousarray(bins).ravel()
        for at in range(0, len(bins), BLOCK):
            first = np.arange(at, min(at + BLOCK, len(bins))) * bins.shape[1]
            for trees in full:
                for k, (depth, feature, cut, value) in enumerate(trees):
                    node = np.zeros(len(first), np.intp)
                    for _ in range(depth):
                        right = flat.take(first + feature.take(node)) > cut.take(node)
                        node += node
                        node += 1
                        node += right
                    out[k, at:at + BLOCK] += value.take(node)
        return out.T


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the softmax loss per class."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(label)), label] -= 1
    return g * weight[:, None], np.maximum(2 * p * (1 - p), _LEAST_HESSIAN) * weight[:, None]


def best_cut(g: np.ndarray, h: np.ndarray, reg_lambda: float, least: float) -> tuple:
    """(gain, bin, left g, left h, right g, right h) of the best cut of one feature's histogram; gain is -inf where none is allowed."""
    total_g, total_h = g.sum(), h.sum()
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = 0.5 * (left_g**2 / (left_h + reg_lambda) + right_g**2 / (right_h + reg_lambda) - total_g**2 / (total_h + reg_lambda))
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    at = int(gain.argmax())
    return float(gain[at]), at, float(left_g[at]), float(left_h[at]), float(right_g[at]), float(right_h[at])


_DIGITS = (11, 11, 11, 11, 11, 9)  # bits of a double that each pass of ``bin_edges`` settles


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order; a missing one counts as 0, as in ``Booster.bins``."""
    bits = (np.nan_to_num(values, nan=0.0) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each feature, exact and over all rows.

    Each pass settles some bits of the quantiles' values, highest first: tasks count their rows by the next bits, beside the values that agree
    with a quantile so far. What comes to the driver depends on the bins, not on the rows.
    """
    filled = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    held = [np.zeros(1, np.uint64) for _ in features]  # settled bits of the quantiles, without repeats
    which = [np.zeros(bins - 1, np.int64) for _ in features]  # the entry of ``held`` of every quantile
    rank: list[np.ndarray] = []  # place of every quantile among the values that agree with it so far
    settled = 0
    for digit in _DIGITS:
        rest = 64 - settled - digit

        def count(batches: Iterator[pa.RecordBatch], held=held, rest=rest, digit=digit) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(len(h) << digit, np.int64) for h in held]
            for batch in batches:
                for i, agreed in enumerate(held):
                    key = _ordered(batch.column(i).to_numpy(zero_copy_only=False).astype(float)) >> np.uint64(rest)
                    own = key >> np.uint64(digit)
                    at = np.minimum(np.searchsorted(agreed, own), len(agreed) - 1)
                    fits = agreed[at] == own
                    place = (at[fits] << digit) + (key[fits] & np.uint64((1 << digit) - 1)).astype(np.int64)
                    found = np.bincount(place)
                    total[i][:len(found)] += found
            for i, t in enumerate(total):
                place = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), i, np.int32)), pa.array(place), pa.array(t[place])], ["feature", "place", "n"])

        got = filled.mapInArrow(count, "feature int, place long, n long").groupBy("feature", "place").agg(F.sum("n").alias("n")).toArrow()
        feature, place, n = (got.column(c).to_numpy() for c in ("feature", "place", "n"))
        if not len(n):
            return [np.zeros(0) for _ in features]
        for i in range(len(features)):
            hist = np.zeros((len(held[i]), 1 << digit), np.int64)
            hist.ravel()[place[feature == i]] = n[feature == i]
            if not settled:
                at = np.arange(1, bins) / bins
                rank.append(np.maximum(np.ceil(hist.sum() * at - 1), 0).astype(np.int64))  # the least value that as large a share does not exceed
            upto = hist.cumsum(axis=1)[which[i]]
            step = (upto <= rank[i][:, None]).sum(axis=1)
            rank[i] = rank[i] - np.where(step > 0, upto[np.arange(bins - 1), np.maximum(step - 1, 0)], 0)
            held[i], which[i] = np.unique((held[i][which[i]] << np.uint64(digit)) | step.astype(np.uint64), return_inverse=True)
        settled += digit
    return [_doubles(h) for h in held]


_BINNED = pa.schema([("bins", pa.binary()), ("label", pa.int32()), ("weight", pa.float64()), ("pick", pa.int64())])


def _binned(df: DataFrame, model: Booster, label: str, weight: str | None, key: str | None, seed: int) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(c) for c in model.codes]), F.col(label).cast("int")) - 1
    pick = F.xxhash64(F.lit(f"boost:{seed}"), *([F.col(key)] if key else [F.col(f) for f in model.features]))
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(model.features)], code.cast("int").alias("label"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), pick.alias("pick")).where("label >= 0 AND weight > 0")
    width = len(model.features)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            packed = model.bins(matrix)
            yield pa.RecordBatch.from_arrays([_texts(packed), *[batch.column(width + i) for i in range(3)]], schema=_BINNED)

    return settle(rows.hint("rebalance").mapInArrow(emit, "bins binary, label int, weight double, pick long"))


def _texts(rows: np.ndarray) -> pa.Array:
    """The bytes of every row."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _bytes(texts: pa.Array) -> np.ndarray:
    """The bytes of texts without nulls, one after the other."""
    start, end = np.frombuffer(texts.buffers()[1], np.int32)[[texts.offset, texts.offset + len(texts)]]
    return np.frombuffer(texts.buffers()[2], np.uint8)[start:end]


def _batch_bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return _bytes(batch.column("bins")).reshape(-1, width)


def _batch_margins(batch: pa.RecordBatch, model: Booster, bins: np.ndarray) -> np.ndarray:
    out = model.margins(bins) + model.start
    if "score" in batch.schema.names:
        out += np.frombuffer(_bytes(batch.column("score")).tobytes(), np.float64).reshape(out.shape)
    return out


def _scored(rows: DataFrame, model: Booster) -> DataFrame:
    """Rows with the written scores and those of the model's rounds added, written."""
    width = len(model.features)
    schema = pa.schema([*_BINNED, ("score", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _batch_margins(batch, model, _batch_bins(batch, width)) - model.start
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in _BINNED.names], _texts(margins)], schema=schema)

    return settle(rows.mapInArrow(emit, "bins binary, label int, weight double, pick long, score binary"))


_SUMS = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])
_CUTS = pa.schema([
    ("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("cut", pa.int32()),
    ("left_g", pa.float64()), ("left_h", pa.float64()), ("right_g", pa.float64()), ("right_h", pa.float64()),
])


def _histograms(rows: DataFrame, model: Booster, trees: list[Tree], level: int, turn: int, subsample: float, chosen: list[np.ndarray], bins: int) -> DataFrame:
    """(class, node, feature, sums of g and h per bin) over a task's rows, for the nodes of a level that may be cut."""
    width, first, count = len(model.features), (1 << level) - 1, 1 << level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), count, width, 2, bins))
        seen = np.zeros((len(trees), count), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            if subsample < 1:
                # Another part of the rows in every round, the same on every attempt of a task.
                mixed = (batch.column("pick").to_numpy().view(np.uint64) ^ np.uint64(turn * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
                batch = batch.filter(pa.array((mixed >> np.uint64(34)) < int(subsample * _LIMIT)))
                if not batch.num_rows:
                    continue
            b = _batch_bins(batch, width)
            g, h = gradients(_batch_margins(batch, model, b), batch.column("label").to_numpy(), batch.column("weight").to_numpy())
            columns = np.ascontiguousarray(b.T)
            for k, tree in enumerate(trees):
                node = tree.leaf_of(b) - first
                here = np.flatnonzero((node >= 0) & (h[:, k] > 0))
                if not len(here):
                    continue
                node, own_g, own_h = node[here], g[here, k], h[here, k]
                seen[k, np.unique(node)] = True
                node *= bins
                for f in chosen[k]:
                    place = node + columns[f].take(here)
                    total[k, :, f, 0] += np.bincount(place, own_g, count * bins).reshape(count, bins)
                    total[k, :, f, 1] += np.bincount(place, own_h, count * bins).reshape(count, bins)
        index = np.array([(k, n, f) for k in range(len(trees)) for n in np.flatnonzero(seen[k]) for f in chosen[k]], np.int32).reshape(-1, 3)
        if len(index):
            k, n, f = index.T
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n + np.int32(first)), pa.array(f), pa.array([x.tobytes() for x in total[k, n, f]], pa.binary())], schema=_SUMS)

    return rows.mapInArrow(add, "k int, node int, feature int, sums binary")


def _cuts(histograms: DataFrame, bins: int, reg_lambda: float, least: float) -> list:
    """Best cut of each (class, node, feature), taken where the tasks' sums meet; a few numbers per node come to the driver.

    A task adds up the histograms that are dealt to it, so it holds some of the level's and none of the rows'.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *place, sums in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                own = np.frombuffer(sums).reshape(2, bins)
                key = tuple(place)
                total[key] = total[key] + own if key in total else own
        found = [(*key, *best_cut(g, h, reg_lambda, least)) for key, (g, h) in sorted(total.items())]
        columns = list(zip(*found)) if found else [()] * len(_CUTS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUTS)], schema=_CUTS)

    numbers = ", ".join(f"{n} double" for n in _CUTS.names[5:])
    return histograms.repartition("k", "node", "feature").mapInArrow(look, f"k int, node int, feature int, gain double, cut int, {numbers}").collect()


def fit_boosted(
    df: DataFrame, codes: list[int], features: list[str] = FEATURES, label: str = "classification", n_estimators: int = N_ESTIMATORS, max_depth: int = MAX_DEPTH,
    learning_rate: float = LEARNING_RATE, subsample: float = SUBSAMPLE, colsample_bytree: float = COLSAMPLE, min_child_weight: float = 1.0, gamma: float = 0.0,
    reg_lambda: float = 1.0, bins: int = BINS, seed: int = SEED, weight: str | None = None, key: str | None = "point_id",
) -> Booster:
    """Boosted trees for the classes ``codes``. Rows of other classes or without a positive weight are left out.

    ``key`` tells rows apart for the part of them that a round sees (``subsample``). The result depends
    on the rows alone but for the last digits of the sums.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    model = Booster(list(features), list(codes), bin_edges(df, features, bins), np.zeros(len(codes)), gains=np.zeros(len(features)))
    rows, since = _binned(df, model, label, weight, key, seed), 0
    random = np.random.default_rng(seed)
    n_features = max(1, round(colsample_bytree * len(features)))
    for turn in range(n_estimators):
        recent = model.since(since)
        trees = [Tree.root(max_depth) for _ in codes]
        chosen = [np.sort(random.permutation(len(features))[:n_features]) for _ in codes]
        for level in range(max_depth):
            best: dict[tuple[int, int], tuple] = {}
            for r in _cuts(_histograms(rows, recent, trees, level, turn, subsample, chosen, bins), bins, reg_lambda, min_child_weight):
                way = (r["gain"], -r["feature"], r["cut"], r["left_g"], r["left_h"], r["right_g"], r["right_h"])
                best[r["k"], r["node"]] = max(best.get((r["k"], r["node"]), way), way)
            grown = False
            for (k, node), (gain, feature, cut, *sums) in best.items():
                tree = trees[k]
                left, right = (-learning_rate * g / (h + reg_lambda) for g, h in (sums[:2], sums[2:]))
                if level == 0:
                    tree.value[node] = -learning_rate * (sums[0] + sums[2]) / (sums[1] + sums[3] + reg_lambda)
                if gain > max(gamma, _LEAST_GAIN):
                    tree.feature[node], tree.cut[node] = -feature, cut
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = left, right
                    model.gains[-feature] += gain
                    grown = True
            if not grown:
                break
        model.rounds.append(trees)
        if (turn + 1) % KEEP == 0 and turn + 1 < n_estimators:
            kept = _scored(rows, model.since(since))
            discard(rows)
            rows, since = kept, turn + 1
    discard(rows)
    return model


def predicted_class(model: Booster) -> Column:
    """Class code with the highest score, as a column over the model's feature columns; the first one on ties."""

    @F.pandas_udf("int")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        codes = np.array(model.codes)
        for frame in batches:
            bins = model.bins(frame.to_numpy(dtype=float))
            yield pd.Series(codes[(model.margins(bins) + model.start).argmax(axis=1)])

    return predict(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))


def score(model: Booster, df: DataFrame, actual: str | None = "classification") -> DataFrame:
    """Predicted class, name and, where the actual class is known, correctness, for the whole table. Map-only."""
    out = df.withColumn("predicted_class", predicted_class(model)).withColumn("predicted_name", class_name_of("predicted_class"))
    return out.withColumn("correct", F.col("predicted_class") == F.col(actual)) if actual else out


def importance(model: Booster) -> dict[str, float]:
    """Share of the summed gains of each feature."""
    total = model.gains.sum()
    return {f: float(g / total) if total else 0.0 for f, g in zip(model.features, model.gains)}
