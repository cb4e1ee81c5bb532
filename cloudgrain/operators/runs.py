"""Tracked runs and trials as tables."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import run_cost
from ..storage import settle
from .density import bin_index
from .ranking import join_on, running_min

# Billing units per hour of each machine setup, and the price of a unit.
SETUP_UNITS = {"1-gpu": 2.0, "4-gpu": 8.0}
UNIT_PRICE = 0.22


_LOG_KEY = ["run_id", "key", "step"]


def log_metrics(df: DataFrame, path: str) -> None:
    """Add rows ``(run_id, run_name, key, step, value)`` to the run log. Nothing is rewritten.

    A row replaces an earlier one of the same run, key and step when the log is read, so an append that
    is repeated after a failure changes nothing.
    """
    df.withColumn("_logged", F.lit(time.time_ns())).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the run log: of each run, key and step the one logged last (the greatest value of one append that repeats it)."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in {*_LOG_KEY, "_logged"}]
    latest = F.max_by(F.struct(*rest), F.struct("_logged", "value"))
    return log.groupBy(*_LOG_KEY).agg(latest.alias("_r")).select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in log.columns if c != "_logged"])


def compact_log(spark: SparkSession, path: str, out: str) -> None:
    """The log without replaced rows, as a log of its own."""
    log_metrics(read_log(spark, path), out)


def melt_metrics(df: DataFrame, id_cols: list[str], name: str, value: str, prefix: str = "acc_") -> DataFrame:
    """Wide per-class numbers to one log row each."""
    return df.select(*id_cols, F.concat(F.lit(prefix), F.col(name)).alias("key"), F.col(value).alias("value"))


def running_best(trials: DataFrame, order: str = "trial", loss: str = "loss", out: str = "best_so_far") -> DataFrame:
    return running_min(trials, [], [order], loss, out)


def best_trial(trials: DataFrame, loss: str = "loss", order: str = "trial", highest: bool = False) -> DataFrame:
    """The whole row of the best trial; the earliest one on ties."""
    rank = F.struct((-F.col(loss) if highest else F.col(loss)).alias("l"), F.col(order).alias("o"))
    return trials.agg(F.min_by(F.struct(*trials.columns), rank).alias("t")).select("t.*")


def latest_run(runs: DataFrame, name: str = "run_name", start: str = "ts", id: str = "run_id") -> DataFrame:
    """The most recently started run of every name; an aggregate, so a name with many runs combines on the map side."""
    newest = F.max_by(F.struct(*[c for c in runs.columns if c != name]), F.struct(start, id))
    return runs.groupBy(name).agg(newest.alias("r")).select(name, "r.*")


def search_runs(runs: DataFrame, run_name: str, limit: int = 1, name: str = "run_name", start: str = "ts", id: str = "run_id") -> DataFrame:
    """Runs of one name, newest first."""
    return runs.where(F.col(name) == run_name).orderBy(F.col(start).desc(), F.col(id).desc()).limit(limit)


def attach_metrics(trials: DataFrame, runs: DataFrame, metrics: list[str], name: str = "run_name") -> DataFrame:
    """Trials with their run's metrics by name; 0.0 where there is no run.

    ``runs`` has one row per name. It is written first: small, it is broadcast;
    large, AQE can split the trials of a name that has very many.
    """
    joined = join_on(trials, settle(runs.select(name, *metrics)), [name], "left")
    return joined.withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in metrics})


def trial_time(trials: DataFrame, elapsed: str = "elapsed_s") -> DataFrame:
    """Time of all trials one after another and side by side."""
    return trials.agg(F.count(F.lit(1)).alias("n_trials"), F.sum(elapsed).alias("sequential"), F.max(elapsed).alias("parallel"))


def with_cost(df: DataFrame, seconds: str = "elapsed_s", units: str = "units_per_hour", price: float = UNIT_PRICE) -> DataFrame:
    return df.withColumn("cost", run_cost(seconds, units, price))


def speedup(df: DataFrame, base: str, name: str = "setup", seconds: str = "elapsed_s") -> DataFrame:
    """Time of the ``base`` setup over each row's time; 0 where a time is zero or missing."""
    ref = df.where(F.col(name) == base).agg(F.min(seconds).cast("double")).first()[0]  # one number
    return df.withColumn("speedup", F.coalesce(F.try_divide(F.lit(ref).cast("double"), F.col(seconds)), F.lit(0.0)))


def compare_setups(setups: DataFrame, metrics: DataFrame, price: float = UNIT_PRICE) -> DataFrame:
    """One row per setup with time, accuracy, cost and model count; a metric that was never logged stays null.

    ``setups``: setup, run_name, units_per_hour, n_models. ``metrics``: run_name, key, value.
    """
    wide = metrics.groupBy("run_name").pivot("key", ["elapsed_s", "final_acc"]).agg(F.max("value"))
    return with_cost(join_on(setups, wide, ["run_name"], "left"), price=price)


def param_grid(spark: SparkSession, **lists) -> DataFrame:
    """All combinations of the listed values (user-given lists, exploded one after another)."""
    grid = spark.range(1)
    for name, values in lists.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid.drop("id")


def param_importance(trials: DataFrame, params: list[str], loss: str = "loss", bins: int | None = None) -> DataFrame:
    """Share of the loss variance that lies between the values of each parameter.

    With ``bins``, each parameter is first cut into that many equal ranges.
    """
    if bins:
        box = trials.agg(*[F.struct(F.min(p).cast("double"), F.max(p).cast("double")).alias(p) for p in params]).first()
        trials = trials.select(loss, *[bin_index(F.col(p), *[F.lit(v).cast("double") for v in box[p]], bins).alias(p) for p in params])
    pair = [F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("v")) for p in params]
    long = trials.select(F.col(loss).cast("double").alias("_l"), F.explode(F.array(*pair)).alias("_p"))
    groups = long.groupBy(F.col("_p.param").alias("param"), F.col("_p.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_l").alias("s"), F.sum(F.col("_l") * F.col("_l")).alias("q"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    return groups.groupBy("param").agg(F.coalesce(F.try_divide(between, total), F.lit(0.0)).alias("importance"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
