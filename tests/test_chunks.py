"""Chunks and neighbours against brute force and by their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrain.operators import chunks as ch
from cloudgrain.operators import neighbors as nb


def cloud(spark, n, seed=0, spread=400, tile="t", extra=()):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(int, rng.integers(-spread, spread, 3)), tile) for i in range(n)] + list(extra)
    return spark.createDataFrame(rows, "point_id long, x_mm long, y_mm long, z_mm long, tile_name string")


def brute(rows, k):
    ids = np.array([r.point_id for r in rows])
    m = np.array([[r.x_mm, r.y_mm, r.z_mm] for r in rows])
    out = set()
    for i, p in zip(ids, m):
        d = ((m - p) ** 2).sum(1)
        for rank, j in enumerate(np.lexsort((ids, d))[:k], 1):
            out.add((int(i), rank, int(ids[j]), int(d[j])))
    return out


def edge_set(df):
    return {(r.point_id, r["rank"], r.neighbour_id, r.d2) for r in df.collect()}


@pytest.mark.parametrize("tail,kept", [(511, 1), (512, 2), (513, 2)])
def test_short_tail(spark, tail, kept):
    cut = ch.assign_chunks(cloud(spark, 4096 + tail))
    assert cut.select("chunk_idx").distinct().count() == kept
    assert cut.count() == 4096 + (tail if kept == 2 else 0)


def test_padding_fills_every_chunk_with_its_own_points(spark):
    cut = ch.assign_chunks(cloud(spark, 300), 128, 32)
    padded = ch.pad_chunks(cut, 128)
    assert {r["count"] for r in padded.groupBy("chunk_idx").count().collect()} == {128}
    own = {(r.chunk_idx, r.point_id) for r in cut.collect()}
    assert {(r.chunk_idx, r.point_id) for r in padded.where("padded").collect()} <= own
    assert padded.groupBy("chunk_idx", "pos").count().where("count > 1").count() == 0


def test_pyramid_is_nested_with_exact_sizes(spark):
    pyr = ch.downsample_pyramid(ch.assign_chunks(cloud(spark, 1000), 1000, 1))
    sizes = {r.stage: r.n_points for r in ch.pyramid_summary(pyr).collect()}
    assert sizes == {0: 1000, 1: 250, 2: 62, 3: 15, 4: 3}
    tiny = ch.downsample_pyramid(ch.assign_chunks(cloud(spark, 3), 10, 1))
    assert {r.stage: r.n_points for r in ch.pyramid_summary(tiny).collect()} == {0: 3, 1: 1, 2: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_chunks_do_not_depend_on_partitioning(spark, parts):
    df = cloud(spark, 700).repartition(parts)
    cut = ch.assign_chunks(df, 128, 32, partitions=parts)
    assert all((r.chunk_idx, r.pos) == divmod(r.point_id, 128) for r in cut.collect())


def test_batches(spark):
    cut = ch.assign_chunks(cloud(spark, 11 * 16), 16, 4)
    sharded = ch.assign_shard(ch.chunk_list(cut), 2)
    full = ch.assign_batches(sharded, 2)
    assert {(r.shard, r["count"]) for r in full.groupBy("shard").count().collect()} == {(0, 6), (1, 4)}
    assert ch.assign_batches(sharded, 2, keep_tail=True).count() == 11
    a, b = (sorted((r.chunk_idx, r.batch) for r in ch.assign_batches(sharded, 2, epoch=e).collect()) for e in (0, 1))
    assert a != b


def test_pack_unpack(spark):
    cut = ch.assign_chunks(cloud(spark, 100), 32, 1)
    back = ch.unpack_chunks(ch.pack_chunks(cut, ["point_id"]))
    assert {(r.chunk_idx, r.pos, r.point_id) for r in back.collect()} == {(r.chunk_idx, r.pos, r.point_id) for r in cut.collect()}


def test_knn_with_ties_and_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, "t"), (2, 5, 0, 0, "t"), (3, -5, 0, 0, "t")], cloud(spark, 1).schema)
    got = edge_set(nb.knn(df, 16, ["tile_name"]))
    assert got == brute(df.collect(), 16)
    assert {(1, 1, 1, 0), (1, 2, 2, 25), (1, 3, 3, 25)} <= got


def test_knn_keeps_groups_apart_and_carries_columns(spark):
    df = cloud(spark, 50).unionByName(cloud(spark, 60, 1, tile="u").withColumn("point_id", F.col("point_id") + 1000))
    edges = nb.knn(df, 4, ["tile_name"], carry=["x_mm"])
    assert edges.where((F.col("point_id") >= 1000) != (F.col("neighbour_id") >= 1000)).count() == 0
    xs = {r.point_id: r.x_mm for r in df.collect()}
    assert all(r.p_x_mm == xs[r.point_id] and r.n_x_mm == xs[r.neighbour_id] for r in edges.collect())


@pytest.mark.parametrize("case", ["even", "pile", "cluster", "single"])
def test_grid_search_equals_brute_force(spark, case):
    pile = [(10_000 + i, 7, 7, 7, "t") for i in range(300)]
    rng = np.random.default_rng(5)
    cluster = [(20_000 + i, *map(int, rng.integers(0, 12, 3)), "t") for i in range(500)]
    df = {"even": cloud(spark, 900), "pile": cloud(spark, 500, extra=pile),
          "cluster": cloud(spark, 300, spread=100_000, extra=cluster), "single": cloud(spark, 1)}[case]
    got = edge_set(nb.knn_grid(df, 8, block=32, fanout=4))
    assert got == brute(df.collect(), 8)


def test_grid_search_by_group_and_group_limit(spark):
    df = cloud(spark, 400).unionByName(cloud(spark, 90, 3, tile="u").withColumn("point_id", F.col("point_id") + 5000))
    want = edge_set(nb.knn(df, 6, ["tile_name"]))
    assert edge_set(nb.knn_grid(df, 6, ["tile_name"], block=16, fanout=4)) == want
    with pytest.raises(Exception, match="max_group"):
        nb.knn(df, 6, ["tile_name"], max_group=100).collect()


def test_knn_on_doubles(spark):
    df = cloud(spark, 200).selectExpr("point_id", "x_mm/1000.0D as x", "y_mm/1000.0D as y", "z_mm/1000.0D as z")
    a = {(r.point_id, r["rank"], r.neighbour_id) for r in nb.knn_grid(df, 5, coords=["x", "y", "z"], block=16, fanout=4).collect()}
    b = {(r.point_id, r["rank"], r.neighbour_id) for r in nb.knn(df.withColumn("g", F.lit(1)), 5, ["g"], ["x", "y", "z"]).collect()}
    assert a == b


def test_upsample_of_chunk_without_coarse_points(spark):
    df = cloud(spark, 20).withColumn("f", F.col("point_id") * 2)
    up = nb.nearest_upsample(df, df.where("point_id < 5"), ["f"], ["tile_name"])
    assert up.count() == 20 and up.where("point_id < 5 and f <> point_id * 2").count() == 0
    none = nb.nearest_upsample(df, df.where("point_id < 0"), ["f"], ["tile_name"])
    assert none.count() == 20 and none.where("f is not null").count() == 0


@pytest.mark.parametrize("axes", [["x_mm", "y_mm"], ["x_mm", "y_mm", "z_mm"]])
@pytest.mark.parametrize("search", [nb.knn, lambda df, k, by, coords: nb.knn_grid(df, k, by, coords, block=64, fanout=4)])
def test_axes_and_null_groups(spark, axes, search):
    df = cloud(spark, 300).withColumn("tile_name", F.when(F.col("point_id") < 150, F.col("tile_name")))
    got = {(r.point_id, r["rank"], r.neighbour_id) for r in search(df, 5, ["tile_name"], axes).collect()}
    want = set()
    pts = df.collect()
    for p in pts:
        near = sorted((sum((p[a] - q[a]) ** 2 for a in axes), q.point_id) for q in pts if q.tile_name == p.tile_name)[:5]
        want |= {(p.point_id, i + 1, q) for i, (_, q) in enumerate(near)}
    assert got == want


def test_pruned_search_equals_all_pairs():
    rng = np.random.default_rng(11)
    for n, m, dims, spread in ((3000, 3000, 3, 900), (2500, 700, 2, 10**6), (4000, 4000, 3, 6), (1, 5000, 3, 100)):
        q = rng.integers(-spread, spread, (n, dims))
        c = q if n == m else rng.integers(-spread, spread, (m, dims))
        for k in (1, 16):
            for x, y in zip(nb._nearest(q, c, k), nb._rank_block(q, c, k)):
                assert (x == y).all()
    far = np.concatenate((rng.integers(0, 50, (2000, 3)), rng.integers(10**6, 10**6 + 50, (5, 3))))
    for x, y in zip(nb._nearest(far, far, 16), nb._rank_block(far, far, 16)):
        assert (x == y).all()


def test_missing_coordinates_are_an_error(spark):
    df = cloud(spark, 20).withColumn("x_mm", F.when(F.col("point_id") > 3, F.col("x_mm")))
    with pytest.raises(Exception, match="without coordinates"):
        nb.knn(df, 3, ["tile_name"]).collect()


def test_upsample_keeps_long_values_exact(spark):
    df = cloud(spark, 30).withColumn("f", F.when(F.col("point_id") != 2, F.lit(9007199254740993)))
    up = nb.nearest_upsample(df, df.where("point_id < 6"), ["f"], ["tile_name"])
    assert {r.f for r in up.collect()} <= {9007199254740993, None} and up.where("f is null and source_id <> 2").count() == 0


def test_straddling_block_has_bounded_reach(spark):
    """Two far clusters: no site's candidates grow with the table, because a second cut bounds its reach."""
    rng = np.random.default_rng(12)
    for n in (600, 2400):
        rows = [(i, *map(int, rng.integers(0, 1000, 3) + (10**7 if i >= n + 5 else 0)), "t") for i in range(2 * n)]
        df = spark.createDataFrame(rows, cloud(spark, 1).schema)
        got = nb.knn_grid(df, 8, block=64, fanout=4)
        assert got.agg(F.max("d2")).first()[0] < 10**9 and got.count() == 8 * 2 * n
