import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrain.llm import curves, neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, rank string, node string, v string, ids string"


def brute(rows, k=nb.NEAREST):
    """{query id: [(distance, id)]} by whole comparison."""
    rows = {(i, tuple(c + 0.0 for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    dim = max((len(v) for _, v in rows), default=0)
    full = [(i, np.array(list(v) + [0.0] * (dim - len(v)), np.float32).astype(float)) for i, v in rows]
    return {(i, tuple(v)): sorted({(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in full if j != i})[:k] for i, v in full if i % 100 == 0}


def search(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)
    return nb.nearest(df, F.col("id") % 100 == 0, **kw).collect()


def lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert len(out[r.query_id]) == r["rank"] or len(out[r.query_id]) > nb.NEAREST
    return out


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curves.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(1 << (dims * bits)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_copies_nulls_zeros_and_odd_lengths(spark):
    rng = np.random.default_rng(3)
    some = [(int(i), [float(np.float32(c)) for c in rng.standard_normal(5)]) for i in range(1, 180)]
    hot = [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(120)]
    odd = [(300, None), (400, [0.0] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [float("inf")] * 5), (None, [1.0] * 5), (800, [1.0, 2.0]), (900, [-0.0, 1.0])]
    rows = some + hot + odd + some[:3] + [hot[0]] * 40
    want = {i: near for (i, _), near in brute(rows).items()}
    assert {i for i in want} == {100, 800, 900, 1000, 1100}
    got = lists(search(spark, rows, block=64))
    assert got.keys() == want.keys() and 1000 in got and 800 in got and 300 not in got
    for i, near in want.items():
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in near], abs=0) and [j for _, j in got[i]] == [j for _, j in near]


def test_few_and_no_candidates(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0, 1.0])]) == []
    assert search(spark, [(0, None), (1, [0.0])]) == []
    assert lists(search(spark, [(0, [1.0, 1.0]), (7, [1.0, 2.0]), (3, [1.0, 2.0])])) == {0: [(1.0, 3), (1.0, 7)]}


def test_two_vectors_of_one_id(spark):
    found = search(spark, [(0, [1.0]), (0, [5.0]), (1, [2.0]), (2, [4.0])])
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 3.0), (2, 2, 3.0)]


def test_recall_of_narrow_windows(spark):
    """Random vectors keep the recall by wide windows, clustered ones with windows of a small part of the table."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    got = lists(nb.nearest(df, F.col("id") % 100 == 0, block=16).collect())
    hit = sum(len({j for _, j in got[i]} & {j for _, j in near}) for (i, _), near in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 40] + 0.01 * rng.standard_normal(32)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows), lists(nb.nearest(df, F.col("id") % 100 == 0, block=16).collect())
    hit = sum(len({j for _, j in got[i]} & {j for _, j in near}) for (i, _), near in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9
