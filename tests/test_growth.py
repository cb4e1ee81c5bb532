"""What keeps the work per row the same on large tables."""

import contextlib
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudgrain import functions as fx
from cloudgrain.operators import chunks, learning, neighbors, ranking
from cloudgrain.sources import las


def test_curve_codes_name_their_input_a_few_times(spark):
    # Spark repeats the expression of a cell for every use in a filter.
    assert str(fx.interleave2(F.col("east"), F.col("north"))).count("east") <= 4
    assert str(fx.interleave3(F.col("east"), F.col("north"), F.col("up"))).count("east") <= 3


def test_curve_codes_are_those_of_the_bits(spark):
    rows = [(0, 0), (1, 0), (0, 1), (2**31 - 1, 0), (0, 2**31 - 1), (123456789, 987654321)]
    got = spark.createDataFrame(rows, "x long, y long").select("x", "y", fx.interleave2(F.col("x"), F.col("y")).alias("z")).collect()
    assert all(r.z == sum((r.x >> i & 1) << 2 * i | (r.y >> i & 1) << 2 * i + 1 for i in range(31)) for r in got)


def test_ranges_are_found_by_generated_code(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 7919 % 5000).alias("v"), "id")
    laid = ranking.with_range(rows, ["k"], ["v", "id"], 11)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        laid.explain(True)
    assert "lambda" not in text.getvalue()
    got = sorted(((r.k, r.v is not None, r.v or 0, r.id), r._p) for r in laid.collect())
    assert [p for _, p in got] == sorted(p for _, p in got) and len({p for _, p in got}) == 11


def test_shards_compute_the_chunk_list_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    dear = spark.range(300).select(F.lit("t").alias("tile_name"), F.col("id").cast("int").alias("chunk_idx")).mapInPandas(count, "tile_name string, chunk_idx int")
    got = chunks.assign_shard(dear, 4).collect()
    assert seen.value == 300
    assert sorted((r.chunk_idx, r.shard) for r in got) == [(i, i % 4) for i in range(300)]


@pytest.mark.parametrize("kind", ["i8", "f8"])
@pytest.mark.parametrize("spread", [6, 20_000])
def test_neighbours_by_the_reach_of_each_point(kind, spread, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.integers(-spread, spread, (3000, 3)).astype(kind)
    want = [neighbors._rank_block(m, m, 16), neighbors._rank_block(m, m[:700], 1)]

    def all_pairs(*_):
        raise AssertionError("whole leaves compared")

    monkeypatch.setattr(neighbors, "_rank_block", all_pairs)
    for (q, c, k), old in zip([(m, m, 16), (m, m[:700], 1)], want):
        for x, y in zip(neighbors._nearest(q, c, k), old):
            assert x.dtype == y.dtype and (x == y).all()


def test_a_block_meets_many_leaves_at_once():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 1000, (400, 3))
    m = m[np.argsort(m[:, 0], kind="stable")]
    ids = rng.permutation(400)
    reach = np.full(100, 1 << 40)
    block = neighbors._Block([(ids[:100], m[:100], np.array([60, 40]), reach)], 8)
    rest = []
    for part in np.split(np.arange(100, 400), [70, 130, 131]):
        rest.extend(part[np.argsort(ids[part])])
    block.meet(ids[rest], m[rest], np.array([70, 60, 1, 169]))
    block._nearest_only()
    order = np.argsort(ids)
    r, j, d2 = neighbors._rank_block(m[:100], m[order], 8)
    assert (block.site[0] == r).all() and (block.near[0] == ids[order][j]).all() and (block.d2[0] == d2).all()


def test_a_file_in_writing_is_held_as_its_records(monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    n = 5000
    cols = {"x": rng.integers(0, 9000, n) / 1000, "y": rng.integers(0, 9000, n) / 1000, "z": rng.integers(-50, 50, n) / 1000,
            "intensity": rng.integers(0, 60000, n).astype("i4"), "classification": rng.integers(0, 9, n).astype("i4")}
    table = pa.table(cols | {"tile_name": ["a.las"] * 3000 + ["b.las"] * 2000, "off_x": [4.0] * n, "off_y": [5.0] * n})

    def whole(*_):
        raise AssertionError("a file's points were held as a table")

    want = [las.encode_tile(table.slice(0, 3000), offset=(4.0, 5.0)), las.encode_tile(table.slice(3000), offset=(4.0, 5.0))]
    monkeypatch.setattr(las, "encode_tile", whole)
    written = las._Writer({"path": str(tmp_path)}, True).write(iter(table.to_batches(max_chunksize=700)))
    assert [open(draft, "rb").read() for draft, _ in written.files] == want


def test_trees_vote_like_spark(spark):
    rows = spark.range(600).selectExpr("id", "cast(id * 7919 % 101 as double) AS u", "cast(id * 31 % 17 as double) AS v",
                                       "cast(CASE WHEN id * 7919 % 101 > 50 THEN 2 WHEN id * 31 % 17 > 8 THEN 6 ELSE 9 END as int) AS classification")
    model = learning.fit_trees(rows, ["u", "v"], n_estimators=7, max_depth=4)
    scored = learning.score(model, rows)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        scored.explain()
    assert "ArrowEvalPython" in text.getvalue()
    want = {r.id: int(r.predicted_label) for r in model.transform(rows).collect()}
    assert {r.id: r.predicted_class for r in scored.collect()} == want


def _odd_chunks(spark):
    """Two chunks and one without a name; repeated ids with values of their own, null ids and null intensities."""
    rng = np.random.default_rng(6)
    rows = []
    for tile, n in (("a", 700), ("b", 90), (None, 40)):
        at = rng.integers(-4000, 4000, (n, 3)).tolist()
        for pos, (x, y, z) in enumerate(at):
            rows.append((tile, 0, pos, 10_000 * n + pos, x, y, z, None if pos % 5 == 0 else pos * 37 % 65_536, pos % 6))
        rows += [(tile, 0, n + i, None if i < 3 else 10_000 * n + i, *at[i], 100 + i, 1) for i in range(9)]
    return spark.createDataFrame(rows, "tile_name string, chunk_idx int, pos int, point_id long, x_mm long, y_mm long, z_mm long, intensity int, classification int")


def test_features_at_all_scales_move_a_chunk_once(spark):
    cut, stages, k = _odd_chunks(spark), 3, 16
    got = learning.multiscale_features(cut, stages, k)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain()
    assert text.getvalue().count("Exchange") == 1 and "Join" not in text.getvalue()
    # The same out of the operators on tables.
    by, key, pooled = [*chunks.CHUNK, "stage"], [*chunks.CHUNK, "point_id"], learning.POOLED
    members = chunks.pyramid_members(chunks.downsample_pyramid(cut, stages - 1))
    edges = neighbors.knn(members, k, by, carry=[*neighbors.MM, "intensity"])
    near = neighbors.relative_encoding(edges, None, by, neighbors.MM, 1000.0, keep=["n_intensity"]).withColumn("intensity", fx.normalize_intensity("n_intensity"))
    near = neighbors.softmax_pool(near, -F.col("distance"), pooled, by)

    def of(s):
        own = near.where(F.col("stage") == s).select(*key, *[F.col(f"pooled_{c}").alias(f"s{s}_{c}") for c in pooled])
        return members.where(F.col("stage") == s).select(*key, *neighbors.MM), own

    want = of(stages - 1)[0].join(of(stages - 1)[1], key)
    for s in range(stages - 2, -1, -1):
        points, own = of(s)
        carried = [c for c in want.columns if c not in {*key, *neighbors.MM}]
        up = neighbors.nearest_upsample(points, want, carried, chunks.CHUNK).drop("source_id", "d2")
        want = points.join(own, key).join(up, key)
    want = want.drop(*neighbors.MM)
    assert got.columns == want.columns

    def rows(df):
        return sorted([tuple("null" if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)

    have, want = rows(got), rows(want)
    assert len(have) == len(want) > 790
    for a, b in zip(have, want):
        assert a[:3] == b[:3] and all(x == y or abs(x - y) < 2e-6 for x, y in zip(a[3:], b[3:]))


def test_neighbours_bring_their_values_without_a_join(spark):
    cut, cols = _odd_chunks(spark), ["intensity", "classification"]
    edges = neighbors.knn(cut, 8, gather=cols).drop("d2")
    got = neighbors.gather_neighbours(edges, None, chunks.CHUNK, cols)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain()
    assert "Join" not in text.getvalue()
    want = neighbors.gather_neighbours(neighbors.knn(cut, 8).drop("d2"), cut, chunks.CHUNK, cols)
    assert got.columns == want.columns and got.count() > 8 * cut.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_the_gather_query_joins_no_edges(spark):
    from cloudgrain.plans import QUERIES

    text = QUERIES["gather_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "neighbour_id" in text and not [line for line in text.splitlines() if "Join" in line and "neighbour_id" in line]
