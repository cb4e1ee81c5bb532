"""Grid cells, cell statistics and scaled-integer coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell_index
from ..schemas import CELL_SIZE, COORD_SCALE
from ..storage import broadcast_checked, settle
from .ranking import join_on

CELL_KEYS = ["tile_name", "cell_x", "cell_y"]


def with_cell(df: DataFrame, size: float = CELL_SIZE, mode: str = "floor", x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("cell_x", cell_index(x, size, mode)).withColumn("cell_y", cell_index(y, size, mode))


def _exact_moments(z: str, unit: float) -> tuple[Column, Column]:
    """Mean and sample deviation from integer sums: the same in any row order.

    The squares are summed in two halves; one long would overflow on a cell
    that holds a large share of a huge table.
    """
    n = F.count(z).cast("double")
    total = F.sum(z).cast("double")
    sq = F.col(z).cast("long") * F.col(z)
    low_bits = (1 << 24) - 1
    squares = (
        F.sum(F.shiftright(sq, 24)).cast("double") * float(1 << 24)
        + F.sum(sq.bitwiseAND(F.lit(low_bits))).cast("double")
    )
    mean = total / n / unit
    spread = F.greatest(n * squares - total * total, F.lit(0.0))
    std = F.when(n > 1, F.sqrt(spread / (n * (n - 1))) / unit)
    return mean, std


def cell_stats(df: DataFrame, z: str = "z", unit: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation (0 for one point), minimum, maximum and range of height per cell.

    ``unit`` says that ``z`` is an integer column with that many units per metre.
    """
    keys = keys or CELL_KEYS
    if unit is None:
        mean, std, scale = F.avg(z), F.stddev_samp(z), 1.0
    else:
        mean, std = _exact_moments(z, unit)
        scale = float(unit)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        mean.alias("z_cell_mean"),
        F.coalesce(std, F.lit(0.0)).alias("z_cell_std"),
        (F.min(z) / scale).alias("z_cell_min"),
        (F.max(z) / scale).alias("z_cell_max"),
        ((F.max(z) - F.min(z)) / scale).alias("z_cell_range"),
    )


def cell_state(df: DataFrame, z: str, keys: list[str] | None = None) -> DataFrame:
    """What statistics of an integer height need per cell: count, sum, squares in two halves, extremes. States add up."""
    keys = keys or CELL_KEYS
    sq = F.col(z).cast("long") * F.col(z)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(z).alias("n_z"), F.sum(F.col(z).cast("long")).alias("sum_z"),
        F.sum(F.shiftright(sq, 24)).alias("sq_high"), F.sum(sq.bitwiseAND(F.lit((1 << 24) - 1))).alias("sq_low"),
        F.min(z).cast("long").alias("min_z"), F.max(z).cast("long").alias("max_z"))


def merge_states(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One state per cell from any number of them, in any order."""
    keys = keys or CELL_KEYS
    return states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_z", "sum_z", "sq_high", "sq_low")], F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"))


def stats_of(states: DataFrame, unit: float, keys: list[str] | None = None) -> DataFrame:
    """The same numbers as ``cell_stats`` over all rows behind the states."""
    keys, n, total = keys or CELL_KEYS, F.col("n_z").cast("double"), F.col("sum_z").cast("double")
    squares = F.col("sq_high").cast("double") * float(1 << 24) + F.col("sq_low").cast("double")
    spread = F.greatest(n * squares - total * total, F.lit(0.0))
    std = F.when(n > 1, F.sqrt(F.try_divide(spread, n * (n - 1))) / unit)
    return states.select(
        *keys, F.col("n").alias("n_points"), (F.try_divide(total, n) / unit).alias("z_cell_mean"), F.coalesce(std, F.lit(0.0)).alias("z_cell_std"),
        (F.col("min_z") / float(unit)).alias("z_cell_min"), (F.col("max_z") / float(unit)).alias("z_cell_max"), ((F.col("max_z") - F.col("min_z")) / float(unit)).alias("z_cell_range"))


def cell_features(
    df: DataFrame, size: float = CELL_SIZE, mode: str = "floor", z: str = "z", unit: float | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Points with the statistics of their cell and their height above its mean.

    Aggregate and join back. The aggregate combines on the map side, so a cell
    that holds a third of all points is one row per task. The statistics are
    written before the join: Spark then knows their size and joins by broadcast
    (no shuffle of points) while they fit, and beyond that both join inputs are
    plain shuffles, the form in which AQE splits a hot cell's points. Points without a tile have cells like others.
    """
    keys = keys or CELL_KEYS
    located = with_cell(df, size, mode)
    stats = cell_stats(located, z, unit, keys).select(*keys, "z_cell_mean", "z_cell_std", "z_cell_range")
    height = F.col(z) if unit is None else F.col(z) / float(unit)
    return join_on(located, settle(stats), keys, "left").withColumn("z_above_cell_mean", height - F.col("z_cell_mean"))


def prepare_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls to 0, then single precision."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("float") for c in cols})


def tile_offsets(df: DataFrame, x: str = "x", y: str = "y", unit: float = 1.0) -> DataFrame:
    """Coordinate offset of every tile: mean x, mean y, zero height."""
    def mean(c):
        return F.sum(c).cast("double") / F.count(c).cast("double") / float(unit)

    return df.groupBy("tile_name").agg(mean(x).alias("off_x"), mean(y).alias("off_y"), F.lit(0.0).alias("off_z"))


def encode_coords(df: DataFrame, offsets: DataFrame | None = None, scale: float = COORD_SCALE) -> DataFrame:
    """Stored integer coordinates ``xi, yi, zi``; ties round to even.

    One offset row per tile; broadcast after a count, so points do not move.
    """
    offs = broadcast_checked(settle(offsets if offsets is not None else tile_offsets(df)), 1_000_000)

    def enc(c):
        return F.rint((F.col(c) - F.col(f"off_{c}")) / F.lit(scale)).cast("int").alias(f"{c}i")

    return join_on(df, offs, ["tile_name"], "left").select("*", enc("x"), enc("y"), enc("z"))


def decode_coords(df: DataFrame, scale: float = COORD_SCALE) -> DataFrame:
    return df.withColumns({c: F.col(f"{c}i") * F.lit(scale) + F.col(f"off_{c}") for c in ("x", "y", "z")})


def tile_summary(df: DataFrame, unit: float = 1.0, x: str = "x", y: str = "y", z: str = "z", header_bytes: int = 227, record_bytes: int = 20) -> DataFrame:
    """What a tile's file header says: counts, bounding box, file size."""
    n = F.count(F.lit(1))
    box = []
    for name, c in (("x", x), ("y", y), ("z", z)):
        box.append((F.min(c) / float(unit)).alias(f"min_{name}"))
        box.append((F.max(c) / float(unit)).alias(f"max_{name}"))
    return df.groupBy("tile_name").agg(
        n.alias("n_points"), n.alias("n_return_1"), *box,
        (F.lit(header_bytes) + F.lit(record_bytes) * n).alias("file_bytes"),
    )
