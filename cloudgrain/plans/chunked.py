"""Queries over chunks, neighbours and files written from the points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import labels, learning, neighbors
from ..schemas import PYRAMID_STAGES
from ..sources.las import read_las, save_las, spoil
from ..storage import load_chunks, save_chunks, save_colocated, work_dir
from .registry import query
from .tables import D2, K, MIN_PTS, N_PTS, chunked_sql, chunks, edges_sql, points

_KEY = "tile_name, chunk_idx"
_ROW = f"{_KEY}, pos, chunk_n, point_id"


def _known(spark, sf):
    return labels.encode_known_classes(points(spark, sf))


@query("assign_chunks", f"SELECT {_ROW} FROM chunked", "points chunked")
def assign_chunks(spark, sf):
    return chunks(spark, sf).select("tile_name", "chunk_idx", "pos", "chunk_n", "point_id")


@query("assign_chunks_distributed", f"SELECT {_ROW} FROM chunked", "points chunked")
def assign_chunks_distributed(spark, sf):
    # More partitions than tiles: every tile is spread over several tasks.
    cut = ch.assign_chunks(_known(spark, sf), N_PTS, MIN_PTS, partitions=61)
    return cut.select("tile_name", "chunk_idx", "pos", "chunk_n", "point_id")


def _zcode(bits: int = 31) -> str:
    cx, cy = ("(CAST(floor({}/2.0E0) AS BIGINT)+1073741824)".format(c) for c in "xy")
    return "+".join(f"((({c}>>{i})&1)<<{2 * i + o})" for i in range(bits) for o, c in ((0, cx), (1, cy)))


@query("assign_chunks_morton", f"SELECT {_ROW} FROM ({chunked_sql('zc, point_id', f'(SELECT *, {_zcode()} AS zc FROM points) zp')}) z")
def assign_chunks_morton(spark, sf):
    cut = ch.assign_chunks(_known(spark, sf), N_PTS, MIN_PTS, order="morton")
    return cut.select("tile_name", "chunk_idx", "pos", "chunk_n", "point_id")


@query("pad_chunks", f"""SELECT {_KEY}, pos, point_id, false AS padded FROM chunked UNION ALL
SELECT m.tile_name, m.chunk_idx, m.target AS pos, c.point_id, true FROM (
  SELECT tile_name, chunk_idx, CAST(t AS INT) AS target, CAST(('0x' || substr(md5('42:' || tile_name || ':' || chunk_idx || ':' || t), 1, 8))::BIGINT % chunk_n AS INT) AS member
  FROM (SELECT tile_name, chunk_idx, chunk_n, unnest(range(chunk_n, {N_PTS})) AS t FROM chunked WHERE pos = 0 AND chunk_n < {N_PTS}) s) m
JOIN chunked c ON c.tile_name = m.tile_name AND c.chunk_idx = m.chunk_idx AND c.pos = m.member""", "points chunked")
def pad_chunks(spark, sf):
    return ch.pad_chunks(chunks(spark, sf), N_PTS).select("tile_name", "chunk_idx", "pos", "point_id", "padded")


@query("downsample_pyramid", f"SELECT {_KEY}, point_id, CAST(top_stage AS INT) AS top_stage FROM pyramid", "points chunked pyramid")
def downsample_pyramid(spark, sf):
    return ch.downsample_pyramid(chunks(spark, sf)).select("tile_name", "chunk_idx", "point_id", "top_stage")


@query("pyramid_summary", f"""SELECT {_KEY}, stage, count(*) AS n_points FROM (
  SELECT tile_name, chunk_idx, CAST(unnest(range(0, top_stage+1)) AS INT) AS stage FROM pyramid) m GROUP BY ALL""", "points chunked pyramid")
def pyramid_summary(spark, sf):
    return ch.pyramid_summary(ch.downsample_pyramid(chunks(spark, sf)))


@query("chunk_roundtrip", f"SELECT {_KEY}, pos, point_id, x_mm, y_mm, z_mm, intensity, class_idx FROM chunked JOIN classes ON classification = class_id", "points classes chunked")
def chunk_roundtrip(spark, sf):
    return ch.unpack_chunks(ch.pack_chunks(chunks(spark, sf), ["point_id", "x_mm", "y_mm", "z_mm", "intensity", "class_idx"]))


@query("chunk_store", f"SELECT {_ROW} FROM chunked", "points chunked")
def chunk_store(spark, sf):
    path = f"{work_dir(spark)}/chunks/{uuid.uuid4().hex}"
    save_chunks(chunks(spark, sf).select("tile_name", "chunk_idx", "pos", "chunk_n", "point_id"), path)
    return load_chunks(spark, path).select("tile_name", "chunk_idx", "pos", "chunk_n", "point_id")


@query("cap_chunks", f"""SELECT {_KEY}, pos, point_id FROM chunked SEMI JOIN (
  SELECT DISTINCT {_KEY} FROM chunked ORDER BY {_KEY} LIMIT 100) f USING (tile_name, chunk_idx)""", "points chunked")
def cap_chunks(spark, sf):
    return ch.cap_chunks(chunks(spark, sf), 100).select("tile_name", "chunk_idx", "pos", "point_id")


_SHARD = f"""SELECT {_KEY}, CAST((row_number() OVER (ORDER BY {_KEY})-1)%4 AS INT) AS shard FROM (SELECT DISTINCT {_KEY} FROM chunked) d"""


@query("assign_shard", _SHARD, "points chunked")
def assign_shard(spark, sf):
    sharded = ch.assign_shard(ch.chunk_list(chunks(spark, sf)), 4)
    return ch.by_shard(sharded, 4).select("tile_name", "chunk_idx", "shard")


@query("mini_batches", f"""SELECT {_KEY}, shard, epoch, CAST(b AS INT) AS batch, CAST(s AS INT) AS slot FROM (
  SELECT *, 3 AS epoch, (r-1)//4 AS b, (r-1)%4 AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5('42:3:' || tile_name || ':' || chunk_idx), tile_name, chunk_idx) AS r,
      count(*) OVER (PARTITION BY shard) AS n FROM ({_SHARD}) a) t) u WHERE b < n//4""", "points chunked")
def mini_batches(spark, sf):
    sharded = ch.assign_shard(ch.chunk_list(chunks(spark, sf)), 4)
    return ch.assign_batches(sharded, 4, epoch=3).select("tile_name", "chunk_idx", "shard", "epoch", "batch", "slot")


@query("knn_chunk", f"SELECT {_KEY}, point_id, CAST(rank AS INT) AS rank, neighbour_id, d2 FROM edges", "points chunked edges")
def knn_chunk(spark, sf):
    return neighbors.knn(chunks(spark, sf), K)


_MEM = f"(SELECT *, CAST(unnest(range(0, least(top_stage, {PYRAMID_STAGES})+1)) AS INT) AS stage FROM pyramid)"
_STAGED = edges_sql("mem", f"{_KEY}, stage")


@query("knn_pyramid", f"SELECT {_KEY}, stage, point_id, CAST(rank AS INT) AS rank, neighbour_id, d2 FROM (WITH mem AS {_MEM} {_STAGED}) e", "points chunked pyramid")
def knn_pyramid(spark, sf):
    members = ch.pyramid_members(ch.downsample_pyramid(chunks(spark, sf)))
    return neighbors.knn(members, K, ["tile_name", "chunk_idx", "stage"])


# Exact neighbours without a size limit: any 256 points give an upper bound of the 16th distance, and cells at least as wide
# as a point's bound (a doubling width per level) hold its neighbours among their own and the eight around them.
_GRID = f"""SELECT a.point_id, CAST(e.rank AS INT) AS rank, n.point_id AS neighbour_id, e.k // {1 << 20} AS d2 FROM (
WITH kp AS (SELECT point_id, x_mm, y_mm, z_mm, row_number() OVER (ORDER BY point_id) AS no FROM points),
g AS (SELECT *, least(o//256, greatest(n//256-1, 0)) AS grp FROM (
  SELECT *, row_number() OVER (ORDER BY floor(x_mm/4000.0E0), y_mm, point_id)-1 AS o, count(*) OVER () AS n FROM kp) q),
ub AS (SELECT no, list_max(l) AS ub FROM (SELECT a.no, min({D2}, {K}) AS l FROM g a JOIN g b USING (grp) GROUP BY a.no) w),
own AS (SELECT kp.*, ub, greatest(0, CAST(ceil(log2((sqrt(ub)+1)/250.0E0)) AS INT)) AS lvl FROM kp JOIN ub USING (no)),
cells AS (SELECT kp.*, lvl, CAST(floor(x_mm/(250.0E0*power(2, lvl))) AS BIGINT) AS cx, CAST(floor(y_mm/(250.0E0*power(2, lvl))) AS BIGINT) AS cy FROM kp, (SELECT DISTINCT lvl FROM own) v),
want AS (SELECT c.*, CAST(floor(x_mm/(250.0E0*power(2, lvl))) AS BIGINT)+dx AS gx, CAST(floor(y_mm/(250.0E0*power(2, lvl))) AS BIGINT)+dy AS gy
  FROM own c, (VALUES (-1),(0),(1)) vx(dx), (VALUES (-1),(0),(1)) vy(dy))
SELECT no, unnest(l) AS k, generate_subscripts(l, 1) AS rank FROM (
  SELECT a.no, min({D2}*{1 << 20}+b.no, {K}) AS l FROM want a JOIN cells b ON a.lvl = b.lvl AND a.gx = b.cx AND a.gy = b.cy AND {D2} <= a.ub GROUP BY a.no) z) e
JOIN (SELECT point_id, row_number() OVER (ORDER BY point_id) AS no FROM points) a ON a.no = e.no
JOIN (SELECT point_id, row_number() OVER (ORDER BY point_id) AS no FROM points) n ON n.no = e.k % {1 << 20}"""


@query("knn_grid", _GRID)
def knn_grid(spark, sf):
    """Neighbours of all points, unclassified ones included."""
    return neighbors.knn_grid(points(spark, sf), K)


_UP = f"""SELECT tile_name, chunk_idx, point_id, arg_min(cid, k) AS source_id, min(k.d2) AS d2, arg_min(ci, k) AS intensity FROM (
  SELECT a.tile_name, a.chunk_idx, a.point_id, b.point_id AS cid, b.intensity AS ci, {{'d2': {D2}, 'id': b.point_id}} AS k
  FROM chunked a JOIN pyramid b ON a.tile_name = b.tile_name AND a.chunk_idx = b.chunk_idx AND b.top_stage >= 1) p GROUP BY 1, 2, 3"""


@query("nearest_upsample", _UP, "points chunked pyramid")
def nearest_upsample(spark, sf):
    pyr = ch.downsample_pyramid(chunks(spark, sf))
    return neighbors.nearest_upsample(pyr, pyr.where(F.col("top_stage") >= 1), ["intensity"], ch.CHUNK)


@query("colocated_upsample", _UP, "points chunked pyramid")
def colocated_upsample(spark, sf):
    """The same from a chunk store whose chunks lie side by side: neither side is shuffled again."""
    name = f"pyramid_{uuid.uuid4().hex}"
    pyr = ch.downsample_pyramid(chunks(spark, sf)).select(*ch.CHUNK, "point_id", *neighbors.MM, "intensity", "top_stage")
    store = save_colocated(pyr, name, 8, ch.CHUNK, ["point_id"], f"{work_dir(spark)}/tables/{name}")
    return neighbors.nearest_upsample(store, store.where(F.col("top_stage") >= 1), ["intensity"], ch.CHUNK)


@query("gather_neighbours", """SELECT e.tile_name, e.chunk_idx, e.point_id, CAST(e.rank AS INT) AS rank, e.neighbour_id, p.intensity AS n_intensity, p.classification AS n_classification
  FROM edges e JOIN points p ON e.neighbour_id = p.point_id""", "points chunked edges")
def gather_neighbours(spark, sf):
    cols = ["intensity", "classification"]
    edges = neighbors.knn(chunks(spark, sf), K, gather=cols).drop("d2")
    return neighbors.gather_neighbours(edges, None, ch.CHUNK, cols)


@query("relative_encoding", """SELECT e.tile_name, e.chunk_idx, e.point_id, CAST(e.rank AS INT) AS rank, e.neighbour_id,
  (p.x_mm-n.x_mm)/1000.0E0 AS rel_x, (p.y_mm-n.y_mm)/1000.0E0 AS rel_y, (p.z_mm-n.z_mm)/1000.0E0 AS rel_z, sqrt(CAST(d2 AS DOUBLE))/1000.0E0 AS distance,
  p.x AS own_x, p.y AS own_y, p.z AS own_z, n.x AS nbr_x, n.y AS nbr_y, n.z AS nbr_z
  FROM edges e JOIN points p ON e.point_id = p.point_id JOIN points n ON e.neighbour_id = n.point_id""", "points chunked edges")
def relative_encoding(spark, sf):
    edges = neighbors.knn(chunks(spark, sf), K, carry=neighbors.MM)
    return neighbors.relative_encoding(edges, None, ch.CHUNK, neighbors.MM, 1000.0)


_POOL = """SELECT tile_name, chunk_idx, point_id, round(sum(w*z)/sum(w), 4) AS pooled_n_z, round(sum(w*i)/sum(w), 4) AS pooled_n_intensity FROM (
  SELECT e.tile_name, e.chunk_idx, e.point_id, n.z, CAST(n.intensity AS DOUBLE) AS i,
    exp(-sqrt(CAST(d2 AS DOUBLE))/1000.0E0 + min(sqrt(CAST(d2 AS DOUBLE))/1000.0E0) OVER (PARTITION BY e.tile_name, e.chunk_idx, e.point_id)) AS w
  FROM edges e JOIN points n ON e.neighbour_id = n.point_id) t GROUP BY 1, 2, 3"""


@query("softmax_pool", _POOL, "points chunked edges")
def softmax_pool(spark, sf):
    edges = neighbors.knn(chunks(spark, sf), K, carry=["z", "intensity"])
    pooled = neighbors.softmax_pool(edges, -F.sqrt(F.col("d2").cast("double")) / 1000.0, ["n_z", "n_intensity"], ch.CHUNK)
    # Intensities reach 65,535: a sixth decimal is within reach of what another order of adding changes.
    return pooled.withColumns({c: F.round(c, 4) for c in ("pooled_n_z", "pooled_n_intensity")})


def _multi_sql(stages: int) -> str:
    """Pooled features of every stage's points, and each point's nearest point of the next stage, followed from stage to stage."""
    pooled = f"""SELECT e.tile_name, e.chunk_idx, e.stage, e.point_id, sum(w*rz)/sum(w) AS rz, sum(w*ds)/sum(w) AS ds, sum(w*it)/sum(w) AS it FROM (
      SELECT e.*, (p.z_mm-n.z_mm)/1000.0E0 AS rz, sqrt(CAST(e.d2 AS DOUBLE))/1000.0E0 AS ds, n.intensity/65535.0E0 AS it,
        exp(-sqrt(CAST(e.d2 AS DOUBLE))/1000.0E0 + min(sqrt(CAST(e.d2 AS DOUBLE))/1000.0E0) OVER (PARTITION BY e.tile_name, e.chunk_idx, e.stage, e.point_id)) AS w
      FROM staged e JOIN points p ON e.point_id = p.point_id JOIN points n ON e.neighbour_id = n.point_id) e GROUP BY 1, 2, 3, 4"""
    up = f"""SELECT u.tile_name, u.chunk_idx, u.stage, u.point_id, n.point_id AS source_id FROM (
      SELECT a.tile_name, a.chunk_idx, a.stage, a.point_id, min({D2}*{N_PTS}+b.pos) AS k
      FROM mem a JOIN mem b ON a.tile_name = b.tile_name AND a.chunk_idx = b.chunk_idx AND b.stage = a.stage+1 GROUP BY 1, 2, 3, 4) u
      JOIN chunked n ON n.tile_name = u.tile_name AND n.chunk_idx = u.chunk_idx AND n.pos = u.k % {N_PTS}"""
    joins, cols, at = [], [], "f0.point_id"
    for s in range(stages):
        if s:
            on = "u{0}.tile_name = f0.tile_name AND u{0}.chunk_idx = f0.chunk_idx AND u{0}.stage = {0} AND u{0}.point_id = {1}".format(s - 1, at)
            joins.append(f"JOIN up u{s - 1} ON {on}")
            at = f"u{s - 1}.source_id"
            joins.append(f"JOIN pooled f{s} ON f{s}.tile_name = f0.tile_name AND f{s}.chunk_idx = f0.chunk_idx AND f{s}.stage = {s} AND f{s}.point_id = {at}")
        cols += [f"round(f{s}.{c}, 6) AS s{s}_{n}" for c, n in (("rz", "rel_z"), ("ds", "distance"), ("it", "intensity"))]
    return f"""SELECT * FROM (WITH mem AS {_MEM}, staged AS ({_STAGED}), pooled AS ({pooled}), up AS ({up})
    SELECT f0.tile_name, f0.chunk_idx, f0.point_id, {", ".join(cols)} FROM pooled f0 {" ".join(joins)} WHERE f0.stage = 0) m"""


@query("multiscale_features", _multi_sql(PYRAMID_STAGES + 1), "points chunked pyramid")
def multiscale_features(spark, sf):
    """All five resolutions."""
    f = learning.multiscale_features(chunks(spark, sf), stages=PYRAMID_STAGES + 1, k=K)
    return f.withColumns({c: F.round(c, 6) for c in f.columns if c[0] == "s" and c[2] == "_"})


@query("bad_files", """SELECT 'PERMISSIVE' AS mode, count(*) AS n_points, CAST(2 AS BIGINT) AS n_corrupt FROM points UNION ALL
  SELECT 'DROPMALFORMED', count(*), 0 FROM points""")
def bad_files(spark, sf):
    """Scan files beside one that ends early and one that is none, in the two modes that go on."""
    path = f"{work_dir(spark)}/las/{uuid.uuid4().hex}"
    save_las(points(spark, sf).select("x", "y", "z", "intensity", "classification", "tile_name"), path)
    spoil(path, "short.las", 100)
    spoil(path, "other.las", 0)
    parts = []
    for mode in ("PERMISSIVE", "DROPMALFORMED"):
        got = read_las(spark, path, mode)
        corrupt = F.col("_corrupt").isNotNull() if mode == "PERMISSIVE" else F.lit(False)
        parts.append(got.agg(F.lit(mode).alias("mode"), F.count(F.when(~corrupt, 1)).alias("n_points"), F.count(F.when(corrupt, 1)).alias("n_corrupt")))
    return parts[0].unionByName(parts[1])


@query("las_roundtrip", "SELECT tile_name, x, y, z, intensity, classification FROM points")
def las_roundtrip(spark, sf):
    """Write every tile as a scan file and read the folder back."""
    path = f"{work_dir(spark)}/las/{uuid.uuid4().hex}"
    save_las(points(spark, sf).select("x", "y", "z", "intensity", "classification", "tile_name"), path)
    back = read_las(spark, path)
    return back.select("tile_name", *[F.round(c, 3).alias(c) for c in "xyz"], "intensity", "classification")
