"""Queries over single points, cells, predictions and histograms."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import density, grid, labels, metrics, sampling
from ..operators.learning import assemble, scoring_udf
from ..operators.runs import union_all
from ..schemas import FEATURES, KNOWN_CLASSES, class_dictionary, conform
from ..storage import broadcast_checked, save_table, table_or, work_dir
from .registry import query
from .tables import points, predictions, scored

UNIT = 1000  # stored coordinate units per metre
_OK = "CAST(classification = predicted_class AS INT)"


@query("points_scan", "SELECT point_id, x, y, z, intensity, classification, tile_name FROM points")
def points_scan(spark, sf):
    return points(spark, sf).select("point_id", "x", "y", "z", "intensity", "classification", "tile_name")


@query("declared_points", "SELECT x, y, z, intensity, classification, tile_name FROM points")
def declared_points(spark, sf):
    """Points cast to the declared schema; a null in one of its fields fails the job."""
    return conform(points(spark, sf))


@query("optional_table", "SELECT 'stored' AS kind, count(*) AS n_points FROM points UNION ALL SELECT 'fallback', count(*) FROM points WHERE classification = 2")
def optional_table(spark, sf):
    """A stored table where there is one, else what the fallback computes."""
    name = f"optional_{uuid.uuid4().hex}"
    save_table(points(spark, sf).select("point_id"), name, path=f"{work_dir(spark)}/tables/{name}")
    fallback = lambda: points(spark, sf).where("classification = 2").select("point_id")
    kinds = [table_or(spark, n, fallback).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_points")) for kind, n in (("stored", name), ("fallback", f"{name}_absent"))]
    return kinds[0].unionByName(kinds[1])


@query("tile_summary", """
SELECT tile_name, count(*) AS n_points, count(*) AS n_return_1, min(x_mm)/1000.0E0 AS min_x, max(x_mm)/1000.0E0 AS max_x,
  min(y_mm)/1000.0E0 AS min_y, max(y_mm)/1000.0E0 AS max_y, min(z_mm)/1000.0E0 AS min_z, max(z_mm)/1000.0E0 AS max_z,
  227 + 20*count(*) AS file_bytes FROM points GROUP BY tile_name""")
def tile_summary(spark, sf):
    return grid.tile_summary(points(spark, sf), UNIT, "x_mm", "y_mm", "z_mm")


_OFFS = """SELECT tile_name, CAST(sum(x_mm) AS DOUBLE)/CAST(count(*) AS DOUBLE)/1000.0E0 AS off_x,
  CAST(sum(y_mm) AS DOUBLE)/CAST(count(*) AS DOUBLE)/1000.0E0 AS off_y, 0.0E0 AS off_z FROM points GROUP BY tile_name"""
_ENC = f"""SELECT point_id, tile_name, off_x, off_y, CAST(round_even((x-off_x)/0.001E0, 0) AS INT) AS xi,
  CAST(round_even((y-off_y)/0.001E0, 0) AS INT) AS yi, CAST(round_even((z-off_z)/0.001E0, 0) AS INT) AS zi, off_z
  FROM points JOIN ({_OFFS}) o USING (tile_name)"""


def _encoded(spark, sf):
    p = points(spark, sf)
    return grid.encode_coords(p, grid.tile_offsets(p, "x_mm", "y_mm", UNIT))


@query("coords_encode", f"SELECT point_id, tile_name, off_x, off_y, xi, yi, zi FROM ({_ENC}) e")
def coords_encode(spark, sf):
    return _encoded(spark, sf).select("point_id", "tile_name", "off_x", "off_y", "xi", "yi", "zi")


@query("coords_decode", f"SELECT point_id, xi*0.001E0+off_x AS x, yi*0.001E0+off_y AS y, zi*0.001E0+off_z AS z FROM ({_ENC}) e")
def coords_decode(spark, sf):
    return grid.decode_coords(_encoded(spark, sf)).select("point_id", "x", "y", "z")


@query("with_class_name", "SELECT point_id, classification, class_name FROM points LEFT JOIN classes ON classification = class_id", "points classes")
def with_class_name(spark, sf):
    return labels.with_class_name(points(spark, sf)).select("point_id", "classification", "class_name")


@query("encode_known_classes", "SELECT point_id, classification, class_idx FROM points JOIN classes ON classification = class_id", "points classes")
def encode_known_classes(spark, sf):
    return labels.encode_known_classes(points(spark, sf)).select("point_id", "classification", "class_idx")


@query("label_dictionary", """SELECT label, CAST(row_number() OVER (ORDER BY label)-1 AS INT) AS label_idx
  FROM (SELECT DISTINCT classification AS label FROM points) d""")
def label_dictionary(spark, sf):
    return labels.fit_labels(points(spark, sf), "classification")


@query("label_roundtrip", """SELECT point_id, classification, label_idx, classification AS decoded FROM points JOIN (
  SELECT label, CAST(row_number() OVER (ORDER BY label)-1 AS INT) AS label_idx
  FROM (SELECT DISTINCT classification AS label FROM points) d) l ON classification = label""")
def label_roundtrip(spark, sf):
    p = points(spark, sf)
    d = labels.fit_labels(p, "classification")
    coded = labels.apply_labels(p.select("point_id", "classification"), d, "classification")
    return labels.invert_labels(coded, d, out="decoded")


@query("broadcast_lookup", "SELECT tile_name, class_name, count(*) AS n FROM points JOIN classes ON classification = class_id GROUP BY ALL", "points classes")
def broadcast_lookup(spark, sf):
    d = broadcast_checked(class_dictionary(spark))
    p = points(spark, sf)
    return p.join(d, p.classification == d.class_id).groupBy("tile_name", "class_name").agg(F.count(F.lit(1)).alias("n"))


@query("cell_floor", "SELECT point_id, cell_x, cell_y FROM celled", "points celled")
def cell_floor(spark, sf):
    return grid.with_cell(points(spark, sf)).select("point_id", "cell_x", "cell_y")


@query("cell_trunc", "SELECT point_id, CAST(trunc(x/2.0E0) AS INT) AS cell_x, CAST(trunc(y/2.0E0) AS INT) AS cell_y FROM points")
def cell_trunc(spark, sf):
    return grid.with_cell(points(spark, sf), mode="trunc").select("point_id", "cell_x", "cell_y")


@query("cell_id_text", "SELECT point_id, cell_x || '_' || cell_y || '_' || tile_name AS cell_id FROM celled", "points celled")
def cell_id_text(spark, sf):
    return grid.with_cell(points(spark, sf)).select("point_id", fx.cell_id().alias("cell_id"))


@query("normalize_intensity", "SELECT point_id, intensity/65535.0E0 AS intensity_01 FROM points")
def normalize_intensity(spark, sf):
    return points(spark, sf).select("point_id", fx.normalize_intensity().alias("intensity_01"))


@query("clip_intensity", "SELECT point_id, least(greatest(intensity*2-30000, 0), 65535) AS clipped FROM points")
def clip_intensity(spark, sf):
    return points(spark, sf).select("point_id", fx.clip(F.col("intensity") * 2 - 30000, 0, 65535).alias("clipped"))


@query("prepare_features", """SELECT point_id, CAST(x AS FLOAT) AS x, CAST(coalesce(CASE WHEN classification <> 1 THEN z END, 0) AS FLOAT) AS z,
  CAST(intensity AS FLOAT) AS intensity FROM points""")
def prepare_features(spark, sf):
    p = points(spark, sf).withColumn("z", F.when(F.col("classification") != 1, F.col("z")))  # unclassified: unknown height
    return grid.prepare_features(p.select("point_id", "x", "z", "intensity"), ["x", "z", "intensity"])


@query("with_correct", "SELECT point_id, classification = predicted_class AS correct FROM points")
def with_correct(spark, sf):
    return predictions(spark, sf).select("point_id", "correct")


@query("filter_tile", "SELECT point_id, x, y, z FROM points WHERE tile_name = 'tile_000.las'")
def filter_tile(spark, sf):
    return points(spark, sf).where(F.col("tile_name") == "tile_000.las").select("point_id", "x", "y", "z")


@query("filter_class", "SELECT point_id, x, y, z FROM points WHERE classification = 6")
def filter_class(spark, sf):
    return points(spark, sf).where(F.col("classification") == 6).select("point_id", "x", "y", "z")


@query("accuracy_band", f"""SELECT tile_name, accuracy, CASE WHEN accuracy >= 0.90E0 THEN 'high' WHEN accuracy >= 0.75E0 THEN 'medium' ELSE 'low' END AS band
  FROM (SELECT tile_name, CAST(sum({_OK}) AS DOUBLE)/count(*) AS accuracy FROM points GROUP BY tile_name) t""")
def accuracy_band(spark, sf):
    return metrics.accuracy_by(predictions(spark, sf), "tile_name").select("tile_name", "accuracy", fx.accuracy_band("accuracy").alias("band"))


@query("veg_class", "SELECT point_id, CASE WHEN z < 4 THEN 3 WHEN z < 10 THEN 4 ELSE 5 END AS veg FROM points")
def veg_class(spark, sf):
    return points(spark, sf).select("point_id", fx.veg_class("z").alias("veg"))


@query("project_predictions", """SELECT x, y, z, intensity, classification, tile_name, predicted_class, class_name AS predicted_name,
  classification = predicted_class AS correct FROM points LEFT JOIN classes ON predicted_class = class_id""", "points classes")
def project_predictions(spark, sf):
    named = labels.with_class_name(predictions(spark, sf), "predicted_class", "predicted_name")
    return named.select("x", "y", "z", "intensity", "classification", "tile_name", "predicted_class", "predicted_name", "correct")


@query("assemble_features", """SELECT point_id, CAST(8 AS INT) AS n_features, x AS f0, y AS f1, z AS f2, CAST(intensity AS DOUBLE) AS f3, z_cell_mean AS f4,
  z_cell_std AS f5, z_cell_range AS f6, z_above_cell_mean AS f7 FROM featured""", "points celled stats featured")
def assemble_features(spark, sf):
    vec = assemble(grid.cell_features(points(spark, sf), z="z_mm", unit=UNIT), FEATURES)
    arr = vec.select("point_id", vector_to_array("features").alias("f"))
    return arr.select("point_id", F.size("f").alias("n_features"), *[F.col("f")[i].alias(f"f{i}") for i in range(len(FEATURES))])


@query("argmax_class", """SELECT point_id, CAST(CASE WHEN s0 = m THEN 0 WHEN s1 = m THEN 1 WHEN s2 = m THEN 2 WHEN s3 = m THEN 3 WHEN s4 = m THEN 4 ELSE 5 END AS INT) AS class_idx
  FROM (SELECT *, greatest(s0,s1,s2,s3,s4,s5) AS m FROM scored) t""", "points scored")
def argmax_class(spark, sf):
    return scored(spark, sf).select("point_id", fx.argmax(F.array(*[f"s{i}" for i in range(6)])).alias("class_idx"))


@query("pct_round", f"SELECT tile_name, round(CAST(sum({_OK}) AS DOUBLE)/count(*)*100, 2) AS pct FROM points GROUP BY tile_name")
def pct_round(spark, sf):
    return predictions(spark, sf).groupBy("tile_name").agg(fx.pct("correct").alias("pct"))


@query("log_count", """SELECT tile_name, round(log10(count(*) FILTER (WHERE classification = 1)), 6) AS log_unclassified, round(log10(count(*)), 6) AS log_points,
  round(500.0E0+3000.0E0*exp(-0.05E0*(max(z_mm)/1000.0E0)), 6) AS strength_at_top FROM points GROUP BY tile_name""")
def log_count(spark, sf):
    return points(spark, sf).groupBy("tile_name").agg(
        F.round(fx.log_count(F.count(F.when(F.col("classification") == 1, 1))), 6).alias("log_unclassified"),
        F.round(fx.log_count(F.count(F.lit(1))), 6).alias("log_points"),
        F.round(fx.height_decay(F.max("z_mm") / 1000.0), 6).alias("strength_at_top"))


@query("cell_stats", "SELECT * FROM stats", "points celled stats")
def cell_stats(spark, sf):
    return grid.cell_stats(grid.with_cell(points(spark, sf)), "z_mm", UNIT)


@query("cell_features", """SELECT point_id, x, y, z, intensity, z_cell_mean, z_cell_std, z_cell_range, z_above_cell_mean, classification, tile_name
  FROM featured""", "points celled stats featured")
def cell_features(spark, sf):
    return grid.cell_features(points(spark, sf), z="z_mm", unit=UNIT).select("point_id", *FEATURES, "classification", "tile_name")


_TCELL = "SELECT *, CAST(trunc(x/2.0E0) AS INT) AS tx, CAST(trunc(y/2.0E0) AS INT) AS ty FROM points"


@query("cell_features_trunc", f"""SELECT point_id, z_cell_mean, z_cell_range FROM ({_TCELL}) p JOIN (
  SELECT tile_name, tx, ty, CAST(sum(z_mm) AS DOUBLE)/CAST(count(*) AS DOUBLE)/1000.0E0 AS z_cell_mean, (max(z_mm)-min(z_mm))/1000.0E0 AS z_cell_range
  FROM ({_TCELL}) t GROUP BY ALL) s USING (tile_name, tx, ty)""")
def cell_features_trunc(spark, sf):
    return grid.cell_features(points(spark, sf), mode="trunc", z="z_mm", unit=UNIT).select("point_id", "z_cell_mean", "z_cell_range")


@query("height_above_cell", "SELECT point_id, z_above_cell_mean FROM featured", "points celled stats featured")
def height_above_cell(spark, sf):
    return grid.cell_features(points(spark, sf), z="z_mm", unit=UNIT).select("point_id", "z_above_cell_mean")


@query("class_profile", """SELECT classification, count(*) AS n_points, round(avg(z_above_cell_mean), 6) AS mean_above, round(avg(z_cell_range), 6) AS mean_range
  FROM featured GROUP BY classification""", "points celled stats featured")
def class_profile(spark, sf):
    return grid.cell_features(points(spark, sf), z="z_mm", unit=UNIT).groupBy("classification").agg(
        F.count(F.lit(1)).alias("n_points"), F.round(F.avg("z_above_cell_mean"), 6).alias("mean_above"),
        F.round(F.avg("z_cell_range"), 6).alias("mean_range"))


@query("class_distribution", """SELECT classification, count(*) AS n_points, round(count(*)*100.0E0/sum(count(*)) OVER (), 1) AS share_pct
  FROM points GROUP BY classification""")
def class_distribution(spark, sf):
    return metrics.class_distribution(points(spark, sf))


@query("sorted_counts", "SELECT classification, count(*) AS n_points FROM points GROUP BY classification ORDER BY classification")
def sorted_counts(spark, sf):
    return metrics.class_distribution(points(spark, sf)).select("classification", "n_points").orderBy("classification")


@query("classes_present", "SELECT DISTINCT classification FROM points ORDER BY classification")
def classes_present(spark, sf):
    return metrics.classes_present(points(spark, sf))


@query("row_counts", """SELECT 'points' AS source, count(*) AS n_rows FROM points UNION ALL SELECT 'known', count(*) FROM points WHERE classification <> 1
  UNION ALL SELECT 'sample', count(*) FROM points WHERE substr(md5('sample:42:' || point_id),1,8) < '147ae148'""")
def row_counts(spark, sf):
    p = points(spark, sf)
    parts = {"points": p, "known": labels.encode_known_classes(p), "sample": sampling.hash_sample(p, 0.08)}
    return union_all([metrics.row_count(d).select(F.lit(n).alias("source"), "n_rows") for n, d in parts.items()])


@query("tile_accuracy", f"""SELECT tile_name, count(*) AS n_points, CAST(sum({_OK}) AS DOUBLE)/count(*) AS accuracy,
  round(CAST(sum({_OK}) AS DOUBLE)/count(*)*100, 2) AS accuracy_pct FROM points GROUP BY tile_name""")
def tile_accuracy(spark, sf):
    return metrics.accuracy_by(predictions(spark, sf), "tile_name")


@query("accuracy_by_prediction", f"""SELECT class_name AS predicted_name, classification, count(*) AS n_points, round(CAST(sum({_OK}) AS DOUBLE)/count(*)*100, 2) AS accuracy_pct
  FROM points LEFT JOIN classes ON predicted_class = class_id GROUP BY ALL ORDER BY 1, 2""", "points classes")
def accuracy_by_prediction(spark, sf):
    named = labels.with_class_name(predictions(spark, sf), "predicted_class", "predicted_name")
    return metrics.accuracy_by(named, "predicted_name", "classification").drop("accuracy").orderBy("predicted_name", "classification")


@query("overall_accuracy", f"SELECT count(*) AS n_points, CAST(sum({_OK}) AS DOUBLE)/count(*) AS accuracy FROM points")
def overall_accuracy(spark, sf):
    return metrics.accuracy(predictions(spark, sf))


@query("class_accuracy", f"""SELECT classification, class_name, count(*) AS n_points, CAST(sum({_OK}) AS DOUBLE)/count(*) AS accuracy
  FROM points LEFT JOIN classes ON classification = class_id GROUP BY ALL""", "points classes")
def class_accuracy(spark, sf):
    acc = metrics.accuracy_by(predictions(spark, sf), "classification")
    return labels.with_class_name(acc).select("classification", "class_name", "n_points", "accuracy")


@query("macro_accuracy", f"""SELECT count(*) AS n_groups, round(avg(accuracy), 9) AS macro_accuracy FROM (
  SELECT tile_name, CAST(sum({_OK}) AS DOUBLE)/count(*) AS accuracy FROM points GROUP BY tile_name) t""")
def macro_accuracy(spark, sf):
    m = metrics.macro_accuracy(metrics.accuracy_by(predictions(spark, sf), "tile_name"))
    return m.select("n_groups", F.round("macro_accuracy", 9).alias("macro_accuracy"))


_CM = """SELECT a.class_id AS actual, p.class_id AS predicted, coalesce(n, 0) AS n FROM classes a CROSS JOIN classes p
  LEFT JOIN (SELECT classification, predicted_class, count(*) AS n FROM points GROUP BY ALL) c
  ON c.classification = a.class_id AND c.predicted_class = p.class_id"""


@query("confusion_long", _CM, "points classes")
def confusion_long(spark, sf):
    return metrics.confusion_matrix(points(spark, sf))


@query("confusion_wide", "SELECT actual, " + ", ".join(
    f"CAST(sum(CASE WHEN predicted = {c} THEN n ELSE 0 END) AS BIGINT) AS pred_{c}" for c in (2, 3, 4, 5, 6, 9)) + f" FROM ({_CM}) m GROUP BY actual", "points classes")
def confusion_wide(spark, sf):
    return metrics.confusion_matrix(points(spark, sf), shape="wide")


@query("confusion_normalized", f"SELECT actual, predicted, n, n/nullif(CAST(sum(n) OVER (PARTITION BY actual) AS DOUBLE), 0) AS share FROM ({_CM}) m", "points classes")
def confusion_normalized(spark, sf):
    return metrics.confusion_matrix(points(spark, sf), normalize="row")


@query("classification_report", f"""
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM (
WITH m AS ({_CM}), r AS (SELECT class_name AS label, precision, recall, CASE WHEN precision+recall = 0 THEN 0.0E0 ELSE 2*precision*recall/(precision+recall) END AS f1, support, tp FROM (
  SELECT class_name, CASE WHEN pre = 0 THEN 0.0E0 ELSE tp/CAST(pre AS DOUBLE) END AS precision, CASE WHEN sup = 0 THEN 0.0E0 ELSE tp/CAST(sup AS DOUBLE) END AS recall, sup AS support, tp
  FROM (SELECT class_name, (SELECT sum(n) FROM m WHERE actual = class_id) AS sup, (SELECT sum(n) FROM m WHERE predicted = class_id) AS pre,
        (SELECT sum(n) FROM m WHERE actual = class_id AND predicted = class_id) AS tp FROM classes) x) y)
SELECT label, precision, recall, f1, support FROM r
UNION ALL SELECT 'accuracy', sum(tp)/CAST(sum(support) AS DOUBLE), sum(tp)/CAST(sum(support) AS DOUBLE), sum(tp)/CAST(sum(support) AS DOUBLE), sum(support) FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM r) z""", "points classes")
def classification_report(spark, sf):
    r = metrics.classification_report(points(spark, sf))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_W = """SELECT class_id, class_idx, n_points, (1.0E0/(n_points+1))/sum(1.0E0/(n_points+1)) OVER ()*6.0E0 AS weight FROM (
  SELECT class_id, class_idx, count(classification) AS n_points FROM classes LEFT JOIN points ON classification = class_id GROUP BY ALL) c"""


@query("class_weights", f"SELECT class_id, class_idx, n_points, round(weight, 9) AS weight FROM ({_W}) w", "points classes")
def class_weights(spark, sf):
    return metrics.class_weights(points(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("weighted_log_loss", f"""SELECT count(*) AS n_points, round(sum(weight*loss)/sum(weight), 6) AS log_loss FROM (
  SELECT weight, -ln(CAST(CASE class_idx WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s4 ELSE s5 END AS DOUBLE)/s_sum) AS loss
  FROM scored JOIN ({_W}) w ON classification = class_id) t""", "points classes scored")
def weighted_log_loss(spark, sf):
    w = metrics.class_weights(points(spark, sf))
    return metrics.weighted_log_loss(scored(spark, sf), w, [f"s{i}" for i in range(6)], "s_sum").withColumn("log_loss", F.round("log_loss", 6))


@query("density_grid", """SELECT classification, CAST(bin_x AS INT) AS bin_x, CAST(bin_y AS INT) AS bin_y, count(*) AS n_points, round(log10(count(*)), 6) AS log10_points FROM (
  SELECT classification, least(floor((x_mm-x0)*120/CAST(x1-x0 AS DOUBLE)), 119) AS bin_x, least(floor((y_mm-y0)*120/CAST(y1-y0 AS DOUBLE)), 119) AS bin_y
  FROM points JOIN (SELECT classification, min(x_mm) AS x0, max(x_mm) AS x1, min(y_mm) AS y0, max(y_mm) AS y1 FROM points GROUP BY 1) b USING (classification)) t
  GROUP BY ALL""")
def density_grid(spark, sf):
    return density.density_grid(points(spark, sf), 120, x="x_mm", y="y_mm")


@query("height_histogram", """SELECT classification, class_name, bin, n_points, n_points/(CAST(sum(n_points) OVER (PARTITION BY classification) AS DOUBLE)*0.31E0) AS density FROM (
  SELECT classification, class_name, CAST(least(floor((z+1.0E0)*100/31.0E0), 99) AS INT) AS bin, count(*) AS n_points
  FROM points JOIN classes ON classification = class_id WHERE z BETWEEN -1 AND 30
    AND classification IN (SELECT classification FROM points GROUP BY 1 HAVING count(*) >= 10) GROUP BY ALL) t""", "points classes")
def height_histogram(spark, sf):
    return density.height_histogram(points(spark, sf))


@query("hash_sample", "SELECT point_id, x, y, z, classification FROM points WHERE substr(md5('sample:42:' || point_id),1,8) < '147ae148'")
def hash_sample(spark, sf):
    return sampling.hash_sample(points(spark, sf), 0.08).select("point_id", "x", "y", "z", "classification")


@query("sample_n_per_group", """SELECT tile_name, point_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_name ORDER BY md5('group:42:' || point_id), point_id) AS r
  FROM points) t WHERE r <= 200""")
def sample_n_per_group(spark, sf):
    return sampling.sample_n_per_group(points(spark, sf), ["tile_name"], 200).select("tile_name", "point_id")


@query("stratified_split", """SELECT point_id, classification, CASE WHEN r <= floor(n*0.2E0+0.5E0) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY classification ORDER BY md5('split:42:' || point_id), point_id) AS r, count(*) OVER (PARTITION BY classification) AS n FROM points) t""")
def stratified_split(spark, sf):
    return sampling.stratified_split(points(spark, sf)).select("point_id", "classification", "split")


@query("random_split", "SELECT point_id, CASE WHEN substr(md5('split:42:' || point_id),1,8) < '33333333' THEN 'test' ELSE 'train' END AS split FROM points")
def random_split(spark, sf):
    return sampling.random_split(points(spark, sf)).select("point_id", "split")


@query("union_tiles", "SELECT point_id, tile_name, classification FROM points")
def union_tiles(spark, sf):
    """Parts of a scene put together again: one part per known class, and the rest."""
    p = points(spark, sf).select("point_id", "tile_name", "classification")
    parts = [p.where(F.col("classification") == c) for c in KNOWN_CLASSES]
    return union_all([*parts, p.where(~F.coalesce(F.col("classification").isin(*KNOWN_CLASSES), F.lit(False)))])


@query("external_scoring", """SELECT point_id, CASE WHEN z < 4 THEN 3 WHEN z < 10 THEN 4 ELSE 5 END AS predicted, classification FROM points""")
def external_scoring(spark, sf):
    """A model from outside Spark, here height limits, loaded once per Python worker."""
    def load():
        import numpy as np

        return lambda batch: np.select([batch["z"] < 4, batch["z"] < 10], [3, 4], 5)

    return points(spark, sf).select("point_id", scoring_udf(load)("z").alias("predicted"), "classification")
