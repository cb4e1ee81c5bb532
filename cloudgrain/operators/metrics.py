"""Quality of predictions.

Every report starts from one map-side combined count per (actual, predicted)
pair; the pairs are few, so all later steps are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import CLASSES, KNOWN_CLASSES, class_dictionary, class_index_of, class_name_of
from ..storage import broadcast_checked, settle

_OTHER = -1  # no class has this code


def class_distribution(df: DataFrame, col: str = "classification") -> DataFrame:
    counts = settle(df.groupBy(col).agg(F.count(F.lit(1)).alias("n_points")))
    return _with_total(counts, "n_points").withColumn("share_pct", F.round(F.col("n_points") * 100.0 / F.col("_total"), 1)).drop("_total")


def _with_total(df: DataFrame, col: str) -> DataFrame:
    """A written table of counts with the sum of ``col`` over all its rows as ``_total``: one number, read and put in as a literal."""
    kind = df.agg(F.sum(col)).schema[0].dataType
    return df.withColumn("_total", F.lit(df.agg(F.sum(col)).first()[0]).cast(kind))


def classes_present(df: DataFrame, col: str = "classification") -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def accuracy(df: DataFrame, correct: str = "correct") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_points"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def accuracy_by(df: DataFrame, *keys: str, correct: str = "correct") -> DataFrame:
    hit = F.avg(F.col(correct).cast("int"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), hit.alias("accuracy"), F.round(hit * 100, 2).alias("accuracy_pct"))


def macro_accuracy(per_group: DataFrame, col: str = "accuracy") -> DataFrame:
    """Unweighted mean over groups."""
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"), F.avg(col).alias("macro_accuracy"))


def confusion_matrix(
    df: DataFrame, actual: str = "classification", predicted: str = "predicted_class", shape: str = "long",
    normalize: str | None = None, labels: list[int] | None = None, other: int | None = None,
) -> DataFrame:
    """Counts of (actual, predicted) over all pairs of ``labels``, absent pairs as 0.

    Rows of other actual classes are not part of the matrix. Predictions outside ``labels``
    (null ones too) are not part of it either, unless ``other`` names a code
    under which they are counted in a column of their own.

    The grid of labels is built from the label list itself (a literal), never
    from the data. ``normalize="row"`` adds the share of the actual class, null
    for a class without points.
    """
    labels = labels or KNOWN_CLASSES
    among = F.when(F.col(predicted).isin(*labels), F.col(predicted).cast("int")).otherwise(F.lit(other).cast("int"))
    known = df.where(F.col(actual).isin(*labels)).select(F.col(actual).cast("int").alias("actual"), among.alias("predicted"))
    counts = known.where("predicted IS NOT NULL").groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    columns = [*labels, *([other] if other is not None else [])]
    grid = df.sparkSession.createDataFrame([(a, p) for a in labels for p in columns], "actual int, predicted int")
    full = grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    if normalize == "row":
        per_row = F.sum("n").over(W.partitionBy("actual"))
        full = full.withColumn("share", F.col("n") / F.nullif(per_row, F.lit(0)))
    if shape == "wide":
        value = "share" if normalize else "n"
        wide = full.groupBy("actual").pivot("predicted", columns).agg(F.first(value))
        return wide.withColumnsRenamed({str(p): "pred_other" if p == other else f"pred_{p}" for p in columns})
    return full


def classification_report(
    df: DataFrame, actual: str = "classification", predicted: str = "predicted_class", labels: list[int] | None = None,
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages; 0 where undefined.

    All rows of a known actual class count: a prediction outside ``labels`` is a miss.
    """
    cm = confusion_matrix(df, actual, predicted, labels=labels, other=_OTHER)
    by_class = (
        cm.withColumn("_right", F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
        .withColumn("_pair", F.explode(F.array(
            F.struct(F.col("actual").alias("c"), F.col("_right").alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pre")),
            F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pre")))))
        .groupBy(F.col("_pair.c").alias("class_id")).agg(F.sum("_pair.tp").alias("tp"), F.sum("_pair.sup").alias("support"), F.sum("_pair.pre").alias("predicted"))
        .where(F.col("class_id") != _OTHER)
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    scored = (
        by_class.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    cols = ["precision", "recall", "f1"]
    rows = scored.select(F.coalesce(class_name_of("class_id"), F.col("class_id").cast("string")).alias("label"), *cols, "support")
    hit = ratio(F.sum("tp"), F.sum("support"))
    acc = scored.agg(hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), F.sum("support").alias("support"))
    macro = scored.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support"))
    weighted = scored.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols],
                          F.sum("support").alias("support"))
    for name, avg in (("accuracy", acc), ("macro avg", macro), ("weighted avg", weighted)):
        rows = rows.unionByName(avg.withColumn("label", F.lit(name)))
    return rows


def class_weights(df: DataFrame, col: str = "classification") -> DataFrame:
    """Inverse-frequency weight of each known class, scaled to sum to their number; from the data's own counts."""
    counts = settle(df.where(F.col(col).isin(*KNOWN_CLASSES)).groupBy(F.col(col).alias("class_id")).agg(F.count(F.lit(1)).alias("n")))
    full = class_dictionary(df.sparkSession).join(counts, "class_id", "left")
    raw = full.withColumn("n_points", F.coalesce("n", F.lit(0).cast("long"))).withColumn("_w", 1.0 / (F.col("n_points") + 1))
    return _with_total(raw, "_w").select("class_id", "class_idx", "n_points", (F.col("_w") / F.col("_total") * F.lit(float(len(CLASSES)))).alias("weight"))


def weighted_log_loss(scored: DataFrame, weights: DataFrame, scores: list[str], total: str, actual: str = "classification") -> DataFrame:
    """Sum of w * -ln(p of the actual class) over the sum of w.

    ``scores[i] / total`` is the probability of class index i. ``weights`` has
    one row per known class, at most six.
    """
    own = F.element_at(F.array(*scores), class_index_of(actual) + 1)
    loss = -F.ln(own / F.col(total))
    joined = scored.where(F.col(actual).isin(*KNOWN_CLASSES)).withColumn("_loss", loss).join(
        broadcast_checked(weights.select(F.col("class_id").alias("_c"), "weight")), F.col(actual) == F.col("_c"))
    return joined.agg(F.count(F.lit(1)).alias("n_points"),
                      (F.sum(F.col("weight") * F.col("_loss")) / F.sum("weight")).alias("log_loss"))


def epoch_metrics(steps: DataFrame, keys: list[str], loss: str = "loss", n_correct: str = "n_correct", n_total: str = "n_total") -> DataFrame:
    """Loss sum, hits, rows and accuracy per step; accuracy of no rows is 0."""
    return steps.groupBy(*keys).agg(
        F.sum(loss).alias("loss_sum"), F.sum(n_correct).alias("n_correct"), F.sum(n_total).alias("n_total"),
        (F.sum(n_correct) / F.greatest(F.sum(n_total), F.lit(1))).alias("accuracy"))
