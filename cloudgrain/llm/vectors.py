"""Vectors of a table as numpy matrices inside Arrow tasks, and sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are there and finite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def dense(column, dim: int, dtype) -> np.ndarray:
    """(rows, dim) matrix of an Arrow list column; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() == dim:
        return flat.reshape(-1, dim).astype(dtype)
    out = np.zeros((len(sizes), dim), dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def packed(matrix: np.ndarray) -> pa.Array:
    """Arrow binary column with the bytes of each row of a matrix."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    data = np.ascontiguousarray(matrix)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array, dim: int, dtype) -> np.ndarray:
    """The matrix whose rows ``packed`` wrote; a column without nulls."""
    if not len(column):
        return np.zeros((0, dim), dtype)
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0])
    return np.frombuffer(column.buffers()[2], dtype, len(column) * dim, first).reshape(-1, dim)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sum over all rows of the ``size`` numbers that ``part`` makes of a batch.

    A task sends one row, and Spark adds up each place, so neither the driver nor a task sees more than
    ``size`` numbers of every other task.
    """
    dtype = np.float64 if kind == "double" else np.int64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size, dtype), False
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(dtype)))], names=["part"])

    found = rows.mapInArrow(add, f"part array<{kind}>").select(F.posexplode("part").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x"))
    out = np.zeros(size, dtype)
    for r in found.collect():
        out[r["place"]] = r["x"]
    return out
