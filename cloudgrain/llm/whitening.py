"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, so counts, sums and deviations are exact. The centred rows X are written
once, as doubles. A step of the bidiagonalisation multiplies them by a vector and its result by
their transpose: both products run over all rows in one Spark job, as a left vector
u = Xw is never longer than its rows' block and only w and Xᵀu (one number per dimension) come to the driver. Both sequences are
orthogonalised against all vectors before them, twice: the right ones directly, the left ones through
UᵀXw = Wᵀ(XᵀXw). By default the bidiagonalisation runs through all dimensions, so its singular values are those of X and nothing has
to converge; it starts again with another direction wherever it ends early (equal or zero variances).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .text import read
from .vectors import dense, finite, packed, summed, unpacked

SCALE, SHIFT = 64, 1_000_000
#: Larger entries count as these: no sum of whole numbers below 2**62 overflows in a task.
LARGEST = 1 << 40
COMPONENTS = 32
#: Variances of less than this share of the largest count as zero.
TINY = 1e-20
_NOISE = 1e-13  # share of the largest entry so far up to which an entry of B is rounding
_SEED = 20240611
_EXACT = 1 << 28  # squares of deviations below this add up in 64 bits over 128 dimensions
_ROWS = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("x", pa.binary())])


@dataclass
class Fitted:
    """``rows``: (vec_id, deviation, x), x the centred vector's doubles. Components are columns, by falling variance."""

    rows: DataFrame
    n: int
    dim: int
    components: np.ndarray
    variances: np.ndarray
    trace: float


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    entries = np.floor(dense(batch.column("v"), dim, np.float64) * SCALE)
    return np.clip(entries, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _squares(numerators: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of the rows of a matrix of whole numbers; null beyond 38 digits."""
    if numerators.dtype != object and np.abs(numerators).max(initial=0) < _EXACT and numerators.shape[1] <= 128:
        sums = (numerators * numerators).sum(axis=1).tolist()
    else:
        sums = [sum(c * c for c in row) for row in numerators.tolist()]
    return [Decimal(s) if s < 10**38 else None for s in sums]


def _centred(rows: DataFrame, n: int, dim: int) -> DataFrame:
    sums = summed(rows, lambda batch: _whole(batch, dim).sum(axis=0), dim, "long")

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch, dim)
            # n * x - S in whole numbers: the centred entry is its quotient by n, rounded once.
            fits = n * (int(np.abs(whole).max(initial=0)) + 1) < 1 << 62
            numerators = whole * n - sums if fits else whole.astype(object) * n - sums.astype(object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(_squares(numerators), pa.decimal128(38, 0)), packed((numerators / n).astype(np.float64))], schema=_ROWS)

    return settle(rows.mapInArrow(centre, "vec_id long, deviation decimal(38,0), x binary"))


def bidiagonalise(rows: DataFrame, dim: int, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) of the centred rows: XV = UB with orthonormal columns, B upper bidiagonal. One job per step."""
    steps = dim if steps is None else min(steps, dim)
    random = np.random.default_rng(_SEED)
    right, left, images = (np.zeros((dim, steps)) for _ in range(3))  # V, W with U = XW, and XᵀU
    b = np.zeros((steps, steps))
    scale = 0.0

    def apart(v: np.ndarray, k: int) -> np.ndarray:
        for _ in range(2):
            v = v - right[:, :k] @ (right[:, :k].T @ v)
        return v

    def fresh(k: int) -> np.ndarray:
        v = apart(random.standard_normal(dim), k)
        return v / np.linalg.norm(v)

    v, beta = fresh(0), 0.0
    for k in range(steps):
        right[:, k] = v
        w = v - beta * left[:, k - 1] if k else v.copy()

        def products(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            x = unpacked(batch.column("x"), dim, np.float64)
            u = x @ w
            return np.append(x.T @ u, u @ u)

        *image, square = summed(rows.select("x"), products, dim + 1)
        image = np.array(image)
        for _ in range(2):
            along = left[:, :k].T @ image
            w, image, square = w - left[:, :k] @ along, image - images[:, :k] @ along, square - along @ along
        alpha = float(np.sqrt(max(square, 0.0)))
        scale = max(scale, alpha, beta)
        q, beta = np.zeros(dim), 0.0
        if alpha > _NOISE * scale * max(1.0, float(np.linalg.norm(w))):
            left[:, k], images[:, k] = w / alpha, image / alpha
            b[k, k] = alpha
            q = apart(images[:, k] - alpha * v, k + 1)
            beta = float(np.linalg.norm(q))
        if k + 1 < steps:
            if beta > _NOISE * scale:
                v, b[k, k + 1] = q / beta, beta
            else:
                v, beta = fresh(k + 1), 0.0
    return right, b


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, steps: int | None = None) -> Fitted:
    """Components and variances of all vectors. ``steps`` ends the bidiagonalisation sooner than after all dimensions."""
    vector = F.col(vector_col)
    rows = vectors.where(finite(vector)).select(F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    if not n or not dim:
        none = rows.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("binary").alias("x")).where("false")
        return Fitted(none, n, dim, np.zeros((dim, 0)), np.zeros(0), 0.0)
    centred = _centred(rows, n, dim)
    trace = float(summed(centred.select("x"), lambda batch: np.array([np.square(unpacked(batch.column("x"), dim, np.float64)).sum()]), 1)[0]) / n
    right, b = bidiagonalise(centred, dim, steps)
    _, deviations, turned = np.linalg.svd(b)
    variances = np.square(deviations) / n
    some = np.flatnonzero(variances > TINY * max(variances.max(initial=0.0), 0.0))[:components]
    axes = right @ turned.T[:, some]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Fitted(centred, n, dim, axes, variances[some], trace)


def identity_error(model: Fitted) -> float:
    """Largest entry of the whitened rows' covariance less the identity; null components: 0."""
    count, dim, n = model.components.shape[1], model.dim, model.n
    if not count:
        return 0.0
    project = model.components / np.sqrt(model.variances)
    rows = model.rows.select("x")
    mean = summed(rows, lambda batch: (unpacked(batch.column("x"), dim, np.float64) @ project).sum(axis=0), count) / n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = unpacked(batch.column("x"), dim, np.float64) @ project - mean
        return (w.T @ w).ravel()

    return float(np.abs(summed(rows, products, count * count).reshape(count, count) / n - np.eye(count)).max())


def whiten(model: Fitted) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained) of every row and component. Map-only."""
    count, dim, n = model.components.shape[1], model.dim, model.n
    project = model.components / np.sqrt(model.variances) if count else model.components
    explained = model.variances / model.trace if count else model.variances
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not count:
                return
            w = unpacked(batch.column("x"), dim, np.float64) @ project
            m = len(w)
            row = pa.array(np.repeat(np.arange(m), count))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n, np.int64)),
                batch.column("deviation").take(row), pa.array(w.ravel()), pa.array(np.tile(explained, m)),
            ], schema=schema)

    return model.rows.mapInArrow(emit, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened embeddings.

    Vectors that are null or hold null or non-finite entries are left out; shorter vectors than the longest end in zeros; repeated
    and null ids are rows like others, equal vectors are whitened alike. Components without variance are left out, so one vector, equal
    vectors or an empty table give no rows. A deviation beyond 64 bits is null (``whiten`` has it as a decimal). Extra columns are ignored.
    """
    model = fit(read(spark, sf_dir, "embeddings"))
    return whiten(model).select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained",
                                F.lit(identity_error(model)).alias("identity_error"))
