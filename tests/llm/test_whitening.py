import math
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from cloudgrain.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component string, deviation string"


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (dim - len(v))]] for _, v in kept]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x]).reshape(n, dim)
    e, axes = np.linalg.eigh(centred.T @ centred / max(n, 1))
    return kept, deviations, centred, e[::-1], axes[:, ::-1]


def whitened(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], SCHEMA).repartition(3)
    model = wh.fit(df, **kw)
    return wh.whiten(model).collect(), wh.identity_error(model)


def agree(got, rows, count):
    kept, deviations, centred, e, axes = brute(rows)
    want = centred @ axes[:, :count] / np.sqrt(e[:count])
    assert len(got) == len(kept) * count
    times = Counter()

    def key(r):
        row = (r.vec_id is None, r.vec_id or 0, r.deviation)
        times[row, r.component] += 1
        return (*row, times[row, r.component], r.component)

    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, deviations[i]))
    table = np.array([r.whitened for r in sorted(got, key=key)]).reshape(-1, count)
    want = want[order]
    want *= np.sign((want * table).sum(axis=0))
    assert np.abs(table - want).max() < 1e-8
    assert sorted({(r.vec_id is None, r.vec_id or 0, r.deviation) for r in got}) == sorted({(kept[i][0] is None, kept[i][0] or 0, Decimal(deviations[i])) for i in order})
    assert {r.n for r in got} == {len(kept)}
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    some = [(i, [float(np.float32(c)) for c in rng.standard_normal(7) * [9, 5, 4, 3, 2, 1, 0.5]]) for i in range(300)]
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 7), (903, [float("inf")] * 7), (None, [1.0] * 7), (904, [2.0, 3.0]), some[0], (None, [-5.0] * 7)]
    got, error = whitened(spark, some + odd)
    agree(got, some + odd, 7)
    assert error < 1e-9
    got, error = whitened(spark, some, components=3)
    agree(got, some, 3)


def test_equal_variances_and_missing_directions(spark):
    """Corners of a cube have one eigenvalue three times; a repeated and a constant dimension have none of their own."""
    rows = [(i, [float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1), float(i & 1), 5.0]) for i in range(8)] * 2
    got, error = whitened(spark, rows)
    assert len(got) == 16 * 3 and error < 1e-9
    assert sorted({r.explained for r in got}) == pytest.approx([0.25, 0.25, 0.5]) or sum({r.component: r.explained for r in got}.values()) == pytest.approx(1.0)


def test_no_variance_and_no_rows(spark):
    assert whitened(spark, []) == ([], 0.0)
    assert whitened(spark, [(1, [1.0, 2.0])]) == ([], 0.0)
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == ([], 0.0)
    assert whitened(spark, [(1, []), (2, None)]) == ([], 0.0)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(np.float32(3.0e6 * (i % 7))), float(i)]) for i in range(50)]
    got, _ = whitened(spark, rows)
    agree(got, rows, 2)


def test_whole_table_of_the_query(spark, sf):
    got = wh.op13_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = got.collect()
    agree(got, rows, 32)
    assert got[0].identity_error < 1e-9
