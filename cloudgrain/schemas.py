"""Declared schemas and the values every operator has to agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------
# (class code, dense index, name) of the six known point classes.
CLASSES = [
    (2, 0, "Ground"),
    (3, 1, "LowVeg"),
    (4, 2, "MedVeg"),
    (5, 3, "HighVeg"),
    (6, 4, "Building"),
    (9, 5, "Water"),
]
# Columns of the classifier's input, in order.
FEATURES = [
    "x", "y", "z", "intensity",
    "z_cell_mean", "z_cell_std", "z_cell_range", "z_above_cell_mean",
]
CELL_SIZE = 2.0          # metres
INTENSITY_MAX = 65535    # unsigned 16 bit
COORD_SCALE = 0.001      # metres per stored coordinate unit
CHUNK_POINTS = 4096
CHUNK_MIN_POINTS = 512
NEIGHBOURS = 16
PYRAMID_STAGES = 4
PYRAMID_RATIO = 4
SEED = 42
# Defaults of the tree classifiers.
N_ESTIMATORS = 300
MAX_DEPTH = 8
LEARNING_RATE = 0.1
SUBSAMPLE = 0.8
COLSAMPLE = 0.8
# --------------------------------------------------------------------------

KNOWN_CLASSES = [code for code, _, _ in CLASSES]

POINT = T.StructType([
    T.StructField("x", T.DoubleType(), False),
    T.StructField("y", T.DoubleType(), False),
    T.StructField("z", T.DoubleType(), False),
    T.StructField("intensity", T.IntegerType(), False),
    T.StructField("classification", T.IntegerType(), False),
    T.StructField("tile_name", T.StringType(), False),
])

PREDICTION = T.StructType(POINT.fields + [
    T.StructField("predicted_class", T.IntegerType()),
    T.StructField("predicted_name", T.StringType()),
    T.StructField("correct", T.BooleanType()),
])


def class_dictionary(spark: SparkSession) -> DataFrame:
    """The six known classes as a table ``(class_id, class_idx, class_name)``."""
    return spark.createDataFrame(CLASSES, "class_id int, class_idx int, class_name string")


def _literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def class_name_of(code) -> Column:
    """Name of a class code, null when unknown; a literal map, so no join."""
    return F.try_element_at(_literal_map((c, n) for c, _, n in CLASSES), F.col(code) if isinstance(code, str) else code)


def class_index_of(code) -> Column:
    return F.try_element_at(_literal_map((c, i) for c, i, _ in CLASSES), F.col(code) if isinstance(code, str) else code)


def class_code_of(index) -> Column:
    return F.try_element_at(_literal_map((i, c) for c, i, _ in CLASSES), F.col(index) if isinstance(index, str) else index)


def conform(df: DataFrame, schema: T.StructType = POINT) -> DataFrame:
    """Cast to a declared schema and fail the job on a null in a NOT NULL field."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNotNull(), c).otherwise(
                F.raise_error(F.lit(f"null in NOT NULL column {f.name}")).cast(f.dataType)
            )
        cols.append(c.alias(f.name))
    return df.select(*cols)


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Raise unless ``df`` has every field of ``schema`` with its type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in have:
            raise ValueError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}")
    return df
