"""Work that is whole at any size: all rows train, and what plans and tasks hold does not grow with them."""

import math
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from cloudgrain.operators import boosting, chunks, learning, neighbors
from cloudgrain.plans import learned


def test_ranges_of_curve_codes_are_planned_quickly(spark):
    # Spark wrote the search for a row's range out as the key of the rank's join: 11 s here, 40 s and gigabytes in assign_chunks_morton, against 0.7 s.
    rows = spark.range(3000).selectExpr("concat('t', id % 3) AS tile_name", "id AS point_id", "id * 7919 % 2000 / 10.0D AS x", "id * 104729 % 2000 / 10.0D AS y")
    for _ in range(4):  # as deep as the plans of tables
        rows = rows.selectExpr("concat(tile_name, '') AS tile_name", "point_id + 0 AS point_id", "x + 0 AS x", "y + 0 AS y")
    cut = chunks.assign_chunks(rows, 256, 32, order="morton", partitions=400)
    began = time.time()
    cut._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 5
    by = {(r.tile_name, r.chunk_idx): r.n for r in cut.groupBy("tile_name", "chunk_idx").agg(F.count("*").alias("n")).collect()}
    assert by == {(f"t{t}", i): 256 if i < 3 else 232 for t in range(3) for i in range(4)}


def test_models_are_fitted_on_all_train_rows(spark):
    rows = spark.range(30_000).selectExpr("id AS point_id", "CASE WHEN id % 5 > 0 THEN 'train' WHEN id % 10 > 0 THEN 'test' END AS split")
    assert learned._train(rows).count() == 24_000


def test_a_forest_grown_in_parts_is_one_forest(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(learning, "TREES_AT_ONCE", 3)
    monkeypatch.setattr(learning, "DRAWS_AT_ONCE", 600)
    rows = spark.range(600).selectExpr("id", "cast(id * 7919 % 101 as double) AS u", "cast(id * 31 % 17 as double) AS v",
                                       "cast(CASE WHEN id * 7919 % 101 > 50 THEN 2 WHEN id * 31 % 17 > 8 THEN 6 ELSE 9 END as int) AS classification")
    model = learning.fit_trees(rows, ["u", "v"], n_estimators=8, max_depth=4)
    forest = next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))
    assert len(forest.trees) == forest.getNumTrees == 8 and forest.numClasses == 3
    assert len({t.toDebugString.partition("\n")[2] for t in forest.trees}) > 3  # the parts draw anew
    assert sum(r.importance for r in learning.feature_importance(model, ["u", "v"]).collect()) == pytest.approx(1)
    learning.save_model(model, str(tmp_path / "m"), rows, ["u", "v"])
    loaded, _ = learning.load_model(spark, str(tmp_path / "m"))
    want = {r.id: int(r.predicted_label) for r in model.transform(rows).collect()}
    assert all({r.id: r.predicted_class for r in learning.score(m, rows).collect()} == want for m in (model, loaded))


@pytest.mark.parametrize("bins", [2, 64, 256])
def test_bins_are_cut_at_exact_quantiles(spark, bins):
    rng = np.random.default_rng(8)
    n = 120_000  # more than a sample once had
    wide, few = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n), rng.integers(-3, 4, n) / 10
    rows = spark.createDataFrame(pd.DataFrame({"wide": wide, "few": few, "gaps": np.where(few > 0.2, np.nan, wide)}))
    for name, got in zip(rows.columns, boosting.bin_edges(rows, rows.columns, bins)):
        values = rows.select(name).toArrow().column(0).to_numpy()
        assert np.array_equal(got, np.unique(np.quantile(np.nan_to_num(values), np.arange(1, bins) / bins, method="inverted_cdf")))


def test_pooling_sums_the_edges_of_a_point_where_they_are(spark):
    rng = np.random.default_rng(9)
    rows = [(tile, i if i % 9 else None, None if rng.random() < 0.2 else float(rng.normal()) * 300, None if rng.random() < 0.3 else int(rng.integers(0, 50)), float(rng.normal()))
            for tile in ("a", None) for i in range(60) for _ in range(16)]
    rows += [rows[7], rows[901]] * 3 + [("b", 1, None, 3, 1.0), ("b", 2, 5.0, None, 1.0), ("b", 3, float("-inf"), 4, 2.0), ("b", 1000, 0.0, 1, 1.0), ("b", 3, 1.0, 6, 3.0)]
    edges = spark.createDataFrame(rows, "tile_name string, point_id long, s double, n int, v double").coalesce(1)
    got = neighbors.softmax_pool(edges, F.col("s"), ["n", "v"], ["tile_name"])
    spread = neighbors.softmax_pool(edges.repartition(7), F.col("s"), ["n", "v"], ["tile_name"])  # runs of one edge
    want: dict = {}
    for tile, i, s, *values in rows:
        want.setdefault((tile, i), []).append((s, values))

    def pooled(of, c):
        own = [(s, v[c]) for s, v in of if s is not None]
        if not any(v is not None for _, v in own):
            return None
        top = max(s for s, _ in own)
        return sum(math.exp(s - top) * v for s, v in own if v is not None) / sum(math.exp(s - top) for s, _ in own)

    for out in (got, spread):
        seen = {(r.tile_name, r.point_id): (r.pooled_n, r.pooled_v) for r in out.collect()}
        assert seen.keys() == want.keys()
        assert all(x is y is None or x == pytest.approx(y, rel=1e-9) for key, of in want.items() for x, y in zip(seen[key], (pooled(of, 0), pooled(of, 1))))
    sent = neighbors._pooled_runs(pa.RecordBatch.from_pylist([{"k": i // 16, "s": 0.0, "v": 1.0} for i in range(320)]), 1,
                                  pa.schema([("k", pa.int64()), ("s", pa.float64()), ("w", pa.float64()), ("v", pa.float64())]))
    assert len(sent) == 20 and sent.column("w").to_pylist() == [16.0] * 20
