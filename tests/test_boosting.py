"""Multi-class boosting and adaptive search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrain.operators import boosting as bo
from cloudgrain.operators import learning as lr

FEATS = ["a", "b", "c"]
CODES = [2, 5, 9]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b, c = (float(v) for v in rng.normal(size=3))
        code = 2 if a + 0.3 * b > 0.4 else 5 if b > 0 else 9
        rows.append((i, a, b if i % 41 else None, c, code, 1.0 + i % 3))
    return spark.createDataFrame(rows, "point_id long, a double, b double, c double, classification int, w double").repartition(5).cache()


def brute_tree(x, g, h, edges, depth, rate, lam=1.0, least=1.0):
    """Heap of (feature, cut, value), every cut tried on the rows themselves."""
    size = (1 << (depth + 1)) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)

    def grow(node, rows, level):
        value[node] = -rate * g[rows].sum() / (h[rows].sum() + lam)
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            for at, edge in enumerate(edges[f]):
                left, right = rows[x[rows, f] <= edge], rows[x[rows, f] > edge]
                if h[left].sum() < least or h[right].sum() < least:
                    continue
                gain = 0.5 * (sum(g[r].sum() ** 2 / (h[r].sum() + lam) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + lam))
                if gain > best[0] + 1e-9:
                    best = (gain, f, at)
        if level == depth or best[1] is None:
            return
        _, feature[node], cut[node] = best
        split = x[rows, best[1]] <= edges[best[1]][best[2]]
        grow(2 * node + 1, rows[split], level + 1)
        grow(2 * node + 2, rows[~split], level + 1)

    grow(0, np.arange(len(x)), 0)
    return feature, cut, value


@pytest.mark.parametrize("weight", [None, "w"])
def test_first_round_equals_numpy(spark, data, weight):
    depth, rate = 3, 0.4
    model = bo.fit_boosted(data, CODES, FEATS, n_estimators=1, max_depth=depth, learning_rate=rate, subsample=1.0, colsample_bytree=1.0, bins=12, weight=weight)
    rows = data.orderBy("point_id").collect()
    x = np.array([[r.a, r.b or 0.0, r.c] for r in rows])
    y = np.array([CODES.index(r.classification) for r in rows])
    w = np.array([r.w if weight else 1.0 for r in rows])
    p = 1 / 3
    for k, tree in enumerate(model.rounds[0]):
        g, h = (p - (y == k)) * w, np.full(len(y), 2 * p * (1 - p)) * w
        feature, cut, value = brute_tree(x, g, h, model.edges, depth, rate)
        assert tree.feature.tolist() == feature.tolist() and tree.cut.tolist() == cut.tolist()
        # Values of nodes that were cut further stay those of the node itself.
        assert np.allclose(tree.value, value, atol=1e-12)


def test_learns_repeats_and_names_importance(spark, data):
    args = dict(n_estimators=12, max_depth=4, learning_rate=0.3)
    model = bo.fit_boosted(data, CODES, FEATS, **args)
    out = bo.score(model, data)
    assert out.agg(F.avg(F.col("correct").cast("int"))).first()[0] > 0.95
    assert out.where("predicted_name IS NULL").count() == 0
    again = bo.score(bo.fit_boosted(data.repartition(2), CODES, FEATS, **args), data)
    assert out.select("point_id", "predicted_class").exceptAll(again.select("point_id", "predicted_class")).count() == 0
    share = bo.importance(model)
    assert sum(share.values()) == pytest.approx(1) and share["c"] < min(share["a"], share["b"])


def test_written_scores_change_nothing(spark, data, monkeypatch):
    args = dict(n_estimators=6, max_depth=3, learning_rate=0.3)
    one = bo.fit_boosted(data, CODES, FEATS, **args)
    monkeypatch.setattr(bo, "KEEP", 2)
    two = bo.fit_boosted(data, CODES, FEATS, **args)
    for a, b in zip(one.rounds, two.rounds):
        for s, t in zip(a, b):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist() and np.allclose(s.value, t.value, atol=1e-9)


def test_edge_rows(spark, data):
    """One class only, constant features, classes without rows and unknown classes."""
    odd = data.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double")).withColumn("c", F.lit(0.0))
    model = bo.fit_boosted(odd, [2, 5, 9, 6], FEATS, n_estimators=2, max_depth=3)
    assert {r[0] for r in bo.score(model, odd).select("predicted_class").distinct().collect()} <= {2, 5, 9}
    none = bo.fit_boosted(data.where("false"), CODES, FEATS, n_estimators=2, max_depth=3)
    assert bo.score(none, data).select("predicted_class").distinct().count() == 1
    with pytest.raises(ValueError):
        bo.fit_boosted(data, CODES, FEATS, bins=1)


def surface(p):
    return (math.log10(p["rate"]) + 2) ** 2 + 0.3 * (p["width"] - 0.7) ** 2 * 10 + (0.0 if p["depth"] == 6 else 0.4)


SPACE = {"rate": ("loguniform", 1e-4, 1.0), "width": ("uniform", 0.0, 1.0), "depth": ("choice", [4, 6, 8, 10])}


def test_adaptive_search_beats_random_draws():
    tuned, drawn = [], []
    for seed in range(12):
        tuned.append(min(loss for _, loss in lr.adaptive_trials(SPACE, surface, 40, seed)))
        drawn.append(min(map(surface, lr.sample_space(SPACE, 40, seed))))
    assert np.mean(tuned) < 0.6 * np.mean(drawn)


def test_adaptive_search_repeats_and_stays_in_space():
    one, two = (lr.adaptive_trials(SPACE, surface, 15, seed=7) for _ in range(2))
    assert one == two and one != lr.adaptive_trials(SPACE, surface, 15, seed=8)
    for p, _ in one:
        assert 1e-4 <= p["rate"] <= 1 and 0 <= p["width"] <= 1 and p["depth"] in (4, 6, 8, 10)


def test_adaptive_search_is_asynchronous():
    """With two workers a slow trial does not hold back the others, and every trial is reported under its number."""
    import time

    started = []

    def slow_first(p):
        started.append(p["width"])
        time.sleep(0.6 if len(started) == 1 else 0.01)
        return p["width"]

    trials = lr.adaptive_trials({"width": ("uniform", 0.0, 1.0)}, slow_first, 8, parallelism=2)
    assert len(trials) == 8 and all(loss == p["width"] for p, loss in trials)
    assert sorted(started) == sorted(p["width"] for p, _ in trials)


def test_densities_add_up():
    for spec, lo, hi in ((("uniform", 0.0, 2.0), 0.0, 2.0), (("loguniform", 1e-3, 10.0), math.log(1e-3), math.log(10.0))):
        _, density = lr._parzen(spec, [0.2, 0.25, 1.9])
        xs = np.linspace(lo + 1e-9, hi - 1e-9, 4001)
        values = np.exp([density(math.exp(x) if spec[0] == "loguniform" else x) for x in xs])
        assert np.trapezoid(values, xs) == pytest.approx(1, abs=1e-3)
    draw, density = lr._parzen(("choice", ["p", "q"]), ["p", "p"])
    assert math.exp(density("p")) == pytest.approx(0.75) and draw(random.Random(1)) in ("p", "q")


def test_margins_are_the_sums_of_the_leaves():
    """Leaves at any depth, blocks of rows, trees of a root alone: the same sums as walking each tree, and no test for leaves on the way."""
    rng = np.random.default_rng(8)

    def tree(depth, share):
        made = bo.Tree.root(depth)
        made.value[0] = rng.normal()
        for node in range((1 << depth) - 1):
            if (not node or made.feature[(node - 1) // 2] >= 0) and rng.random() < share:
                made.feature[node], made.cut[node] = rng.integers(5), rng.integers(0, 255)
                made.value[[2 * node + 1, 2 * node + 2]] = rng.normal(size=2)
        return made

    for depth, share in ((1, 0.0), (3, 0.6), (6, 0.9), (8, 1.0)):
        model = bo.Booster(list("abcde"), [2, 3], [], np.zeros(2), [[tree(depth, share) for _ in range(2)] for _ in range(3)])
        for n in (0, 1, bo.BLOCK + 3):
            bins = rng.integers(0, 256, (n, 5)).astype(np.uint8)
            want = np.zeros((n, 2))
            for trees in model.rounds:
                for k, one in enumerate(trees):
                    want[:, k] += one.value[one.leaf_of(bins)]
            assert np.array_equal(model.margins(bins), want)
    filled = [t.filled() for trees in model.rounds for t in trees]
    assert all(depth == 8 and len(value) == 511 for depth, _, _, value in filled)
