"""Point, class, score and run tables derived from the supplied parquet tables.

The SQL is valid in Spark and in DuckDB. Coordinates are whole millimetres, as
in scan files, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunks import assign_chunks
from ..operators.labels import encode_known_classes
from ..schemas import CHUNK_MIN_POINTS, CHUNK_POINTS, NEIGHBOURS

N_PTS, MIN_PTS, K = CHUNK_POINTS, CHUNK_MIN_POINTS, NEIGHBOURS

POINTS = """
SELECT point_id, x_mm, y_mm, z_mm, x_mm/1000.0E0 AS x, y_mm/1000.0E0 AS y, z_mm/1000.0E0 AS z,
       intensity, classification, tile_name, predicted_class
FROM (
  SELECT (((ok*8+ln)*100000+pk)*1000+sk)*64+q AS point_id,
    (t % 5)*22000 + (pk*7919+ok*104729) % 20000 - 33000 AS x_mm,
    CAST((t - t % 5)/5 AS BIGINT)*22000 + (ok*15485863+ln*32452843+pk*31) % 20000 - 33000 AS y_mm,
    CASE ln WHEN 1 THEN q*2-50 WHEN 2 THEN 300+q*40 WHEN 3 THEN 3000+q*120 WHEN 4 THEN 8000+q*150
            WHEN 5 THEN 5000+q*400 WHEN 6 THEN q-80 ELSE q*500-1000 END AS z_mm,
    CAST(ep % 65536 AS INT) AS intensity,
    CAST(CASE ln WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 9 ELSE 1 END AS INT) AS classification,
    'tile_' || lpad(CAST(t AS STRING), 3, '0') || '.las' AS tile_name,
    CAST(CASE WHEN tx >= 7
      THEN (CASE ln WHEN 1 THEN 9 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 2 ELSE 6 END)
      ELSE (CASE ln WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 9 ELSE 2 END) END AS INT) AS predicted_class
  FROM (
    SELECT CAST(l_suppkey % 20 AS BIGINT) AS t, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln,
           l_partkey AS pk, l_suppkey AS sk, CAST(floor(l_quantity) AS BIGINT) AS q,
           CAST(floor(l_extendedprice) AS BIGINT) AS ep, CAST(round(l_tax*100) AS BIGINT) AS tx
    FROM {lineitem}) k
) p
"""

SCORED = """
SELECT *, s0+s1+s2+s3+s4+s5 AS s_sum FROM (
  SELECT point_id, tile_name, classification, predicted_class,
    1 + (point_id % 997)*3 % 10 + CASE WHEN predicted_class = 2 THEN 40 ELSE 0 END AS s0,
    1 + (point_id % 997)*4 % 10 + CASE WHEN predicted_class = 3 THEN 40 ELSE 0 END AS s1,
    1 + (point_id % 997)*5 % 10 + CASE WHEN predicted_class = 4 THEN 40 ELSE 0 END AS s2,
    1 + (point_id % 997)*6 % 10 + CASE WHEN predicted_class = 5 THEN 40 ELSE 0 END AS s3,
    1 + (point_id % 997)*7 % 10 + CASE WHEN predicted_class = 6 THEN 40 ELSE 0 END AS s4,
    1 + (point_id % 997)*8 % 10 + CASE WHEN predicted_class = 9 THEN 40 ELSE 0 END AS s5
  FROM {points}) z
"""

RUN_METRICS = """
SELECT CAST((event_id - event_id % 10)/10 AS BIGINT) AS run_id,
       'run_' || CAST(CAST((event_id - event_id % 10)/10 AS BIGINT) % 12 AS STRING) AS run_name,
       CAST(event_id % 10 AS INT) AS step, ts, CAST(round(value*100) AS BIGINT) AS loss_c,
       user_id % 90 AS n_correct, CAST(100 AS BIGINT) AS n_total
FROM {events}
"""

TRIALS = """
SELECT CAST((event_id - 9)/10 AS BIGINT) AS trial,
       'run_' || CAST(CAST((event_id - 9)/10 AS BIGINT) % 12 AS STRING) AS run_name,
       CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 300 END AS lr_micro,
       CASE WHEN user_id % 3 = 0 THEN 2 ELSE 4 END AS batch_size,
       CAST(round(value*100) AS BIGINT) AS loss_c, 3000 + user_id % 1000 AS elapsed_cs
FROM {events} WHERE event_id % 10 = 9
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS, lineitem=table(spark, sf_dir, "lineitem"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import with_correct

    return with_correct(points(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCORED, points=points(spark, sf_dir))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUN_METRICS, events=table(spark, sf_dir, "events"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRIALS, events=table(spark, sf_dir, "events"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-class points cut into chunks."""
    return assign_chunks(encode_known_classes(points(spark, sf_dir)), N_PTS, MIN_PTS)


def _chunked_sql(order: str, source: str = "points", n: int = N_PTS, least: int = MIN_PTS) -> str:
    return f"""
SELECT * FROM (
  SELECT r.*, CAST((rn-1)//{n} AS INT) AS chunk_idx, CAST((rn-1)%{n} AS INT) AS pos,
         CAST(least({n}, total-((rn-1)//{n})*{n}) AS INT) AS chunk_n
  FROM (SELECT *, row_number() OVER (PARTITION BY tile_name ORDER BY {order}) AS rn,
               count(*) OVER (PARTITION BY tile_name) AS total
        FROM {source} WHERE classification <> 1) r) c
WHERE chunk_n >= {least}"""


_PYRAMID = """
SELECT c.*, CASE WHEN r <= greatest(n//256, 1) THEN 4 WHEN r <= greatest(n//64, 1) THEN 3
                 WHEN r <= greatest(n//16, 1) THEN 2 WHEN r <= greatest(n//4, 1) THEN 1 ELSE 0 END AS top_stage
FROM (SELECT *, row_number() OVER (PARTITION BY tile_name, chunk_idx ORDER BY md5('pyramid:42:' || point_id), point_id) AS r,
             count(*) OVER (PARTITION BY tile_name, chunk_idx) AS n FROM chunked) c"""

D2 = "((a.x_mm-b.x_mm)*(a.x_mm-b.x_mm)+(a.y_mm-b.y_mm)*(a.y_mm-b.y_mm)+(a.z_mm-b.z_mm)*(a.z_mm-b.z_mm))"


def edges_sql(source: str, group: str = "tile_name, chunk_idx") -> str:
    """The K nearest points of the same group: distance and position in the chunk (which follows the ids) in one number, so
    that DuckDB keeps K numbers per point and sorts no pairs."""
    keys = [g.strip() for g in group.split(",")]
    own = ", ".join(f"a.{g}" for g in keys)
    same = " AND ".join(f"a.{g} = b.{g}" for g in keys)
    match = " AND ".join(f"e.{g} = n.{g}" for g in keys)
    return f"""
SELECT {", ".join(f"e.{g}" for g in keys)}, e.point_id, e.rank, n.point_id AS neighbour_id, e.k // {N_PTS} AS d2 FROM (
  SELECT *, unnest(l) AS k, generate_subscripts(l, 1) AS rank FROM (
    SELECT {own}, a.point_id, min({D2}*{N_PTS}+b.pos, {K}) AS l FROM {source} a JOIN {source} b ON {same} GROUP BY {own}, a.point_id) g) e
JOIN {source} n ON {match} AND n.pos = e.k % {N_PTS}"""


_EDGES = edges_sql("chunked")

CTES = {
    "points": POINTS.format(lineitem="lineitem"),
    "classes": "SELECT CAST(id AS INT) AS class_id, CAST(idx AS INT) AS class_idx, name AS class_name FROM (VALUES "
               "(2,0,'Ground'),(3,1,'LowVeg'),(4,2,'MedVeg'),(5,3,'HighVeg'),(6,4,'Building'),(9,5,'Water')) AS v(id, idx, name)",
    "scored": SCORED.format(points="points"),
    "run_metrics": RUN_METRICS.format(events="events"),
    "trials": TRIALS.format(events="events"),
    "celled": "SELECT *, CAST(floor(x/2.0E0) AS INT) AS cell_x, CAST(floor(y/2.0E0) AS INT) AS cell_y FROM points",
    "stats": """SELECT tile_name, cell_x, cell_y, count(*) AS n_points,
        CAST(sum(z_mm) AS DOUBLE)/CAST(count(*) AS DOUBLE)/1000.0E0 AS z_cell_mean,
        CASE WHEN count(*) > 1 THEN sqrt(greatest(CAST(count(*) AS DOUBLE)*CAST(sum(z_mm*z_mm) AS DOUBLE)
             - CAST(sum(z_mm) AS DOUBLE)*CAST(sum(z_mm) AS DOUBLE), 0.0E0)
             / (CAST(count(*) AS DOUBLE)*(CAST(count(*) AS DOUBLE)-1.0E0)))/1000.0E0 ELSE 0.0E0 END AS z_cell_std,
        min(z_mm)/1000.0E0 AS z_cell_min, max(z_mm)/1000.0E0 AS z_cell_max, (max(z_mm)-min(z_mm))/1000.0E0 AS z_cell_range
        FROM celled GROUP BY ALL""",
    "featured": """SELECT p.*, s.z_cell_mean, s.z_cell_std, s.z_cell_range, p.z_mm/1000.0E0 - s.z_cell_mean AS z_above_cell_mean
        FROM celled p LEFT JOIN stats s USING (tile_name, cell_x, cell_y)""",
    "chunked": _chunked_sql("point_id"),
    "pyramid": _PYRAMID,
    "edges": _EDGES,
}


def chunked_sql(order: str, source: str) -> str:
    return _chunked_sql(order, source)
