"""Column expressions; everything here stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CELL_SIZE, INTENSITY_MAX

__all__ = [
    "cell_index", "cell_id", "clip", "normalize_intensity", "accuracy_band", "veg_class", "pct",
    "argmax", "log_count", "height_decay", "digest", "digest_below", "digest_int", "interleave2",
    "interleave3", "run_cost", "squared_distance",
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cell_index(col, size: float = CELL_SIZE, mode: str = "floor") -> Column:
    """Grid cell of a coordinate: ``floor`` is even across zero, ``trunc`` rounds toward it."""
    q = _c(col) / F.lit(float(size))
    if mode == "floor":
        return F.floor(q).cast("int")
    if mode == "trunc":
        return q.cast("int")
    raise ValueError(f"unknown cell mode {mode!r}")


def cell_id(cell_x="cell_x", cell_y="cell_y", tile="tile_name") -> Column:
    return F.concat_ws("_", _c(cell_x), _c(cell_y), _c(tile))


def clip(col, lo, hi) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def normalize_intensity(col="intensity") -> Column:
    return _c(col) / F.lit(float(INTENSITY_MAX))


def accuracy_band(col) -> Column:
    # Band limits.
    return F.when(_c(col) >= 0.90, "high").when(_c(col) >= 0.75, "medium").otherwise("low")


def veg_class(height) -> Column:
    """Vegetation class of a total height in metres."""
    # Height limits and class codes.
    return F.when(_c(height) < 4, 3).when(_c(height) < 10, 4).otherwise(5)


def pct(flag, digits: int = 2) -> Column:
    return F.round(F.avg(_c(flag).cast("int")) * 100, digits)


def argmax(scores) -> Column:
    """Index of the largest element of an array, the first one on ties."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def log_count(col) -> Column:
    """log10 of a positive count; null for an empty bin."""
    return F.log10(F.when(_c(col) > 0, _c(col)))


def height_decay(z) -> Column:
    """Return strength expected at a height."""
    # Base, amplitude and decay rate.
    return F.lit(500.0) + F.lit(3000.0) * F.exp(F.lit(-0.05) * _c(z))


def digest(seed, *cols) -> Column:
    """Repeatable pseudo-random text of a row: independent of partitioning and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def digest_below(dig: Column, fraction: float) -> Column:
    """True for about ``fraction`` of all digests."""
    limit = round(fraction * 2**32)
    if limit >= 2**32:
        return F.lit(True)
    return F.substring(dig, 1, 8) < F.lit(f"{limit:08x}")


def digest_int(dig: Column) -> Column:
    """First 32 bits of a digest as a number."""
    return F.conv(F.substring(dig, 1, 8), 16, 10).cast("long")


def _spread(v: Column, n_bytes: int, apart: int) -> Column:
    """The bits of the low bytes of ``v``, ``apart`` places from each other.

    A table holds every byte's answer. Masks and shifts would name ``v`` twice per step, and where Spark inlines the
    expression (a filter), 32 times in all.
    """
    table = F.array(*[F.lit(sum((byte >> i & 1) << apart * i for i in range(8))).cast("long") for byte in range(256)])
    out = None
    for i in range(n_bytes):
        part = F.shiftleft(F.get(table, F.shiftrightunsigned(v, 8 * i).bitwiseAND(F.lit(255)).cast("int")), 8 * apart * i)
        out = part if out is None else out.bitwiseOR(part)
    return out


def interleave2(x: Column, y: Column) -> Column:
    """Morton code of two non-negative integers below 2**31."""
    a, b = (_spread(v.cast("long"), 4, 2) for v in (x, y))
    return a.bitwiseOR(F.shiftleft(b, 1))


def interleave3(x: Column, y: Column, z: Column) -> Column:
    """Morton code of three non-negative integers below 2**21."""
    a, b, c = (_spread(v.cast("long"), 3, 3) for v in (x, y, z))
    return a.bitwiseOR(F.shiftleft(b, 1)).bitwiseOR(F.shiftleft(c, 2))


def run_cost(seconds, units_per_hour, unit_price) -> Column:
    """Price of a run: hours x billing units per hour x price per unit."""
    return _c(seconds) / F.lit(3600.0) * _c(units_per_hour) * F.lit(unit_price)


def squared_distance(a: list[str], b: list[str]) -> Column:
    out = None
    for p, q in zip(a, b):
        d = F.col(p) - F.col(q)
        out = d * d if out is None else out + d * d
    return out
