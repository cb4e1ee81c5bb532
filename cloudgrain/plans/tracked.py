"""Queries over tracked runs and trials."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import density, metrics, runs
from ..operators.labels import with_class_name
from ..storage import work_dir
from .registry import query
from .tables import predictions, run_metrics, trials

_RUNS = """SELECT run_id, run_name, min(ts) AS start, max(CASE WHEN step = 9 THEN n_correct/CAST(n_total AS DOUBLE) END) AS final_acc,
  sum(loss_c) AS loss_sum FROM run_metrics GROUP BY run_id, run_name"""


def _runs(spark, sf):
    r = run_metrics(spark, sf)
    return r.groupBy("run_id", "run_name").agg(
        F.min("ts").alias("start"), F.max(F.when(F.col("step") == 9, F.col("n_correct") / F.col("n_total"))).alias("final_acc"),
        F.sum("loss_c").alias("loss_sum"))


_LATEST = f"SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY start DESC, run_id DESC) AS rk FROM ({_RUNS}) q) l WHERE rk = 1"


@query("latest_run", f"SELECT run_name, run_id, final_acc, CAST(loss_sum AS BIGINT) AS loss_sum FROM ({_LATEST}) l", "run_metrics")
def latest_run(spark, sf):
    return runs.latest_run(_runs(spark, sf), start="start").select("run_name", "run_id", "final_acc", "loss_sum")


@query("search_runs", f"SELECT run_id, run_name, final_acc FROM ({_RUNS}) r WHERE run_name = 'run_3' ORDER BY start DESC, run_id DESC LIMIT 1", "run_metrics")
def search_runs(spark, sf):
    return runs.search_runs(_runs(spark, sf), "run_3", start="start").select("run_id", "run_name", "final_acc")


@query("trial_metrics", f"""SELECT trial, t.run_name, coalesce(final_acc, 0.0E0) AS final_acc FROM trials t
  LEFT JOIN ({_LATEST}) r ON t.run_name = r.run_name""", "run_metrics trials")
def trial_metrics(spark, sf):
    latest = runs.latest_run(_runs(spark, sf), start="start")
    return runs.attach_metrics(trials(spark, sf), latest, ["final_acc"]).select("trial", "run_name", "final_acc")


@query("epoch_metrics", """SELECT run_name, step, CAST(sum(loss_c) AS BIGINT) AS loss_sum, CAST(sum(n_correct) AS BIGINT) AS n_correct, CAST(sum(n_total) AS BIGINT) AS n_total,
  sum(n_correct)/CAST(greatest(sum(n_total), 1) AS DOUBLE) AS accuracy FROM run_metrics GROUP BY run_name, step""", "run_metrics")
def epoch_metrics(spark, sf):
    return metrics.epoch_metrics(run_metrics(spark, sf), ["run_name", "step"], loss="loss_c")


@query("log_metrics", """SELECT run_id, run_name, 'loss' AS key, step, CAST(loss_c AS DOUBLE) AS value FROM run_metrics UNION ALL
  SELECT run_id, run_name, 'n_correct', step, CAST(n_correct AS DOUBLE) FROM run_metrics""", "run_metrics")
def log_metrics(spark, sf):
    """Two metrics appended to one run log, each of them twice, as after a failure, and read back."""
    steps = run_metrics(spark, sf)
    path = f"{work_dir(spark)}/runlog/{uuid.uuid4().hex}"
    for key, col in (("loss", "loss_c"), ("n_correct", "n_correct"), ("loss", "loss_c"), ("n_correct", "n_correct")):
        runs.log_metrics(steps.select("run_id", "run_name", F.lit(key).alias("key"), "step", F.col(col).cast("double").alias("value")), path)
    return runs.read_log(spark, path).select("run_id", "run_name", "key", "step", "value")


@query("running_best", "SELECT trial, loss_c, min(loss_c) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far FROM trials", "trials")
def running_best(spark, sf):
    return runs.running_best(trials(spark, sf), loss="loss_c").select("trial", "loss_c", "best_so_far")


@query("best_trial", "SELECT * FROM trials ORDER BY loss_c, trial LIMIT 1", "trials")
def best_trial(spark, sf):
    return runs.best_trial(trials(spark, sf), loss="loss_c")


@query("trial_time", "SELECT count(*) AS n_trials, CAST(sum(elapsed_cs) AS BIGINT) AS sequential, max(elapsed_cs) AS parallel FROM trials", "trials")
def trial_time(spark, sf):
    return runs.trial_time(trials(spark, sf), "elapsed_cs")


@query("loss_histogram", """SELECT CAST(b AS INT) AS bin, lo+(hi-lo)*b/15 AS bin_lo, lo+(hi-lo)*(b+1)/15 AS bin_hi, (SELECT count(*) FROM trials
  WHERE least(floor((loss_c-lo)*15/(hi-lo)), 14) = b) AS n
  FROM (SELECT CAST(min(loss_c) AS DOUBLE) AS lo, CAST(max(loss_c) AS DOUBLE) AS hi, unnest(range(0, 15)) AS b FROM trials) r""", "trials")
def loss_histogram(spark, sf):
    return density.histogram(trials(spark, sf), "loss_c", 15)


@query("run_cost", "SELECT trial, elapsed_cs/100.0E0/3600.0E0*(CASE WHEN batch_size = 2 THEN 2.0E0 ELSE 8.0E0 END)*0.22E0 AS cost FROM trials", "trials")
def run_cost(spark, sf):
    t = trials(spark, sf).select("trial", (F.col("elapsed_cs") / 100.0).alias("elapsed_s"),
                                 F.when(F.col("batch_size") == 2, runs.SETUP_UNITS["1-gpu"]).otherwise(runs.SETUP_UNITS["4-gpu"]).alias("units_per_hour"))
    return runs.with_cost(t).select("trial", "cost")


@query("speedup", """SELECT run_name, elapsed_cs, (SELECT CAST(sum(elapsed_cs) AS DOUBLE) FROM trials WHERE run_name = 'run_0')/elapsed_cs AS speedup
  FROM (SELECT run_name, CAST(sum(elapsed_cs) AS BIGINT) AS elapsed_cs FROM trials GROUP BY run_name) t""", "trials")
def speedup(spark, sf):
    per_run = trials(spark, sf).groupBy("run_name").agg(F.sum("elapsed_cs").alias("elapsed_cs"))
    return runs.speedup(per_run, "run_0", "run_name", "elapsed_cs")


@query("compare_setups", f"""SELECT t.run_name, n_models, units_per_hour, elapsed_s, final_acc, elapsed_s/3600.0E0*units_per_hour*0.22E0 AS cost FROM (
  SELECT run_name, count(*) AS n_models, CASE WHEN run_name IN ('run_1', 'run_2') THEN 8.0E0 ELSE 2.0E0 END AS units_per_hour, CAST(sum(elapsed_cs) AS DOUBLE)/100.0E0 AS elapsed_s
  FROM trials GROUP BY run_name) t LEFT JOIN (SELECT run_name, final_acc FROM ({_LATEST}) l) r ON t.run_name = r.run_name""", "run_metrics trials")
def compare_setups(spark, sf):
    t = trials(spark, sf)
    units = F.when(F.col("run_name").isin("run_1", "run_2"), runs.SETUP_UNITS["4-gpu"]).otherwise(runs.SETUP_UNITS["1-gpu"])
    setups = t.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_models")).withColumn("units_per_hour", units)
    time = t.groupBy("run_name").agg((F.sum("elapsed_cs").cast("double") / 100.0).alias("value")).withColumn("key", F.lit("elapsed_s"))
    acc = runs.latest_run(_runs(spark, sf), start="start").select("run_name", F.col("final_acc").alias("value"), F.lit("final_acc").alias("key"))
    return runs.compare_setups(setups, time.unionByName(acc))


@query("melt_metrics", """SELECT 'acc_' || class_name AS key, CAST(sum(CAST(classification = predicted_class AS INT)) AS DOUBLE)/count(*) AS value
  FROM points JOIN classes ON classification = class_id GROUP BY class_name""", "points classes")
def melt_metrics(spark, sf):
    acc = with_class_name(metrics.accuracy_by(predictions(spark, sf), "classification")).where(F.col("class_name").isNotNull())
    return runs.melt_metrics(acc, [], "class_name", "accuracy")


@query("param_grid", """SELECT lr_micro, batch_size, count(trial) AS n_trials, min(loss_c) AS best_loss FROM (VALUES (1000), (300)) l(lr_micro) CROSS JOIN (VALUES (2), (4)) b(batch_size)
  LEFT JOIN trials USING (lr_micro, batch_size) GROUP BY ALL""", "trials")
def param_grid(spark, sf):
    grid = runs.param_grid(spark, lr_micro=[1000, 300], batch_size=[2, 4])
    done = trials(spark, sf).groupBy("lr_micro", "batch_size").agg(F.count(F.lit(1)).alias("_n"), F.min("loss_c").alias("best_loss"))
    return grid.join(done, ["lr_micro", "batch_size"], "left").select(
        "lr_micro", "batch_size", F.coalesce("_n", F.lit(0).cast("long")).alias("n_trials"), "best_loss")


_IMP = """SELECT '{p}' AS param, (sum(s*s/n)-sum(s)*sum(s)/sum(n))/(sum(q)-sum(s)*sum(s)/sum(n)) AS importance FROM (
  SELECT {p}, CAST(count(*) AS DOUBLE) AS n, sum(CAST(loss_c AS DOUBLE)) AS s, sum(CAST(loss_c AS DOUBLE)*loss_c) AS q FROM trials GROUP BY 1) g"""


@query("param_importance", "SELECT param, round(importance, 9) AS importance FROM (" + " UNION ALL ".join(_IMP.format(p=p) for p in ("lr_micro", "batch_size")) + ") i", "trials")
def param_importance(spark, sf):
    return runs.param_importance(trials(spark, sf), ["lr_micro", "batch_size"], "loss_c").withColumn("importance", F.round("importance", 9))
