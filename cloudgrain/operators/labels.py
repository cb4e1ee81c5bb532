"""Class codes, names and dense indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KNOWN_CLASSES, class_index_of, class_name_of
from ..storage import broadcast_checked
from .ranking import rank_within


def with_class_name(df: DataFrame, col: str = "classification", out: str = "class_name") -> DataFrame:
    return df.withColumn(out, class_name_of(col))


def encode_known_classes(df: DataFrame, col: str = "classification", out: str = "class_idx") -> DataFrame:
    """Dense index of the known classes; rows of any other class are dropped.

    The class filter is a literal IN list, so it reaches the file scan.
    """
    return df.where(F.col(col).isin(*KNOWN_CLASSES)).withColumn(out, class_index_of(col))


def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """Dictionary ``(label, label_idx)`` of the distinct values in ascending order."""
    distinct = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return rank_within(distinct, [], ["label"], "rn").select("label", (F.col("rn") - 1).cast("int").alias("label_idx"))


def apply_labels(df: DataFrame, dictionary: DataFrame, col: str, out: str = "label_idx") -> DataFrame:
    d = broadcast_checked(dictionary.select(F.col("label").alias("_l"), F.col("label_idx").alias(out)))
    return df.join(d, F.col(col) == F.col("_l"), "left").drop("_l")


def invert_labels(df: DataFrame, dictionary: DataFrame, col: str = "label_idx", out: str = "label") -> DataFrame:
    d = broadcast_checked(dictionary.select(F.col("label_idx").alias("_i"), F.col("label").alias(out)))
    return df.join(d, F.col(col) == F.col("_i"), "left").drop("_i")


def with_correct(df: DataFrame, actual: str = "classification", predicted: str = "predicted_class", out: str = "correct") -> DataFrame:
    return df.withColumn(out, F.col(actual) == F.col(predicted))
