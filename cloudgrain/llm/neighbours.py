"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on ``DIMS`` directions and numbered along a Hilbert curve, in ``ORDERINGS`` ways with
other directions and another shift each. Every ordering is range-partitioned and cut into blocks of
``BLOCK`` neighbours on the curve. A query meets the blocks within its window in each ordering, exact
distances are taken there, and the windows' nearest are merged.

Windows are as wide as the data need. For a sample of at most ``SAMPLE`` vectors the true neighbours among all rows
are known (the sample against all rows, in blocks); the window is the least number of places that finds a share of ``RECALL`` of
them in at least one ordering. On clustered vectors that is a small part of the table; vectors without structure, such as random ones
in many dimensions, make wide windows, because no ordering keeps their neighbours together.

Equal vectors are one node with its ``k + 1`` least ids: more of them cannot be in any result, so a vector that a
third of all rows hold costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import rank_written
from ..storage import discard, settle
from .curves import hilbert_keys
from .text import read
from .vectors import dense, finite, packed, unpacked

NEAREST = 10
ORDERINGS, DIMS, BITS = 4, 8, 7
BLOCK = 1024
SAMPLE = 256  # vectors whose true neighbours set the window
FIT_ROWS, FIT_BYTES = 4096, 1 << 24  # vectors that set the directions, and their size at most
RECALL = 0.97
_SEED = 20240617
_CLOSE = 1e-9  # what a distance by products may be off, as a share of the squared lengths


@dataclass
class Curves:
    """Directions (ordering, dimension, direction), and the lowest value and width of each projection."""

    axes: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def keys(self, vectors: np.ndarray, ordering: int) -> np.ndarray:
        cells = (vectors.astype(np.float64) @ self.axes[ordering] - self.low[ordering]) / self.width[ordering] * (1 << BITS)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def fit_curves(sample: np.ndarray, orderings: int = ORDERINGS, dims: int = DIMS) -> Curves:
    """Directions inside the sample's leading ones, turned at random per ordering; the grid is shifted by up to half its width."""
    random = np.random.default_rng(_SEED)
    dim = sample.shape[1]
    dims = min(dims, dim)
    centred = sample - sample.mean(axis=0) if len(sample) else sample
    leading = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :min(dim, 8 * dims)]
    axes, low, width = [], [], []
    for _ in range(orderings):
        turn = np.linalg.qr(random.standard_normal((leading.shape[1], leading.shape[1])))[0][:, :dims]
        axes.append(leading @ turn)
        seen = sample @ axes[-1]
        span = np.maximum(np.ptp(seen, axis=0), 1e-12) if len(seen) else np.ones(dims)
        shift = random.uniform(0, 0.5, dims) * span
        low.append((seen.min(axis=0) if len(seen) else np.zeros(dims)) - shift)
        width.append(1.5 * span)
    return Curves(np.array(axes), np.array(low), np.array(width))


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, h1, h2), nodes (node, least, ids, h1, h2, v), and the longest vector's length."""
    vector = F.col(vector_col)
    # Adding 0 makes a negative zero a zero, so equal vectors have equal hashes.
    rows = vectors.where(F.col(id_col).isNotNull() & finite(vector)).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda c: c + F.lit(0).cast("float")).alias("v"))
    rows = rows.where(F.exists("v", lambda c: c != 0)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(77), F.reverse("v"))})
    # Copies are combined before the shuffles: repeated rows by the distinct, equal vectors by the aggregate and by the
    # limit, which Spark applies before the shuffle too.
    same = W.partitionBy("h1", "h2").orderBy("id")
    least = rows.select("h1", "h2", "id").distinct().withColumn("_rank", F.row_number().over(same)).where(F.col("_rank") <= k + 1)
    ids = least.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = ids.join(rows.groupBy("h1", "h2").agg(F.first("v").alias("v")), ["h1", "h2"])
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()))
    return rows.drop("v"), nodes, nodes.agg(F.max(F.size("v"))).first()[0] or 0


def _sample(nodes: DataFrame, n: int, most: int, purpose: str) -> DataFrame:
    """About ``most`` nodes by hash; each purpose has its own."""
    return nodes.where(F.pmod(F.xxhash64(F.lit(purpose), "h1", "h2"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))


def _matrix(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("node", "v").toArrow()
    return table.column("node").to_numpy(), dense(table.column("v"), dim, np.float64) if len(table) else np.zeros((0, dim))


def nearest_in(queries: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows of ``block`` of each query, ties to smaller ids.

    Products find who may be among them; distances are then taken entry by entry, so that a
    pair has the same one wherever it is found.
    """
    far = np.square(queries).sum(axis=1)[:, None] - 2 * queries @ block.T + np.square(block).sum(axis=1)
    k = min(k, len(block))
    edge = np.partition(far, k - 1, axis=1)[:, k - 1] + _CLOSE * (np.square(queries).sum(axis=1) + np.square(block).sum(axis=1).max())
    q, b = np.nonzero(far <= edge[:, None])
    distance = np.empty(len(q))
    for lo in range(0, len(q), 4096):
        part = slice(lo, lo + 4096)
        distance[part] = np.sqrt(np.square(queries[q[part]] - block[b[part]]).sum(axis=1))
    order = np.lexsort((ids[b], distance, q))
    q, b, distance = q[order], b[order], distance[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], b[keep], distance[keep]


_HITS = pa.schema([("q", pa.int64()), ("node", pa.int64()), ("least", pa.int64()), ("distance", pa.float64())])
_HITS_SQL = "q long, node long, least long, distance double"


def _hits(q: np.ndarray, queries: np.ndarray, node: np.ndarray, least: np.ndarray, block: np.ndarray, k: int) -> pa.RecordBatch:
    at, row, distance = nearest_in(queries, block, least, k)
    return pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(node[row]), pa.array(least[row]), pa.array(distance)], schema=_HITS)


def _nearest_of(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest nodes of each query; a node that several windows found counts once."""
    order = W.partitionBy("q").orderBy("distance", "least", "node")
    return hits.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= k).groupBy("q", "node").agg(F.first("distance").alias("distance"))


def _true_nearest(nodes: DataFrame, q: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest nodes of a bounded set of vectors, among all nodes."""
    dim = vectors.shape[1]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                yield _hits(q, vectors, part.column("node").to_numpy(), part.column("least").to_numpy(), dense(part.column("v"), dim, np.float64), k)

    return _nearest_of(nodes.select("node", "least", "v").mapInArrow(look, _HITS_SQL), k)


def _ordered(nodes: DataFrame, curves: Curves, dim: int, dtype) -> DataFrame:
    """(ordering, rank, node, least, v: bytes) of every node in every ordering; ranks from 0."""
    schema = pa.schema([("ordering", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("least", pa.int64()), ("v", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                vectors = dense(part.column("v"), dim, dtype)
                for o in range(len(curves.axes)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vectors), o, np.int32)), pa.array(curves.keys(vectors, o)), part.column("node"), part.column("least"), packed(vectors)], schema=schema)

    keyed = nodes.select("node", "least", "v").mapInArrow(emit, "ordering int, key long, node long, least long, v binary")
    return rank_written(keyed, ["ordering"], ["key", "node"], out="rank").select("ordering", (F.col("rank") - 1).alias("rank"), "node", "least", "v")


def window_for(ordered: DataFrame, true: DataFrame, recall: float) -> int:
    """The least distance of ranks within which a share ``recall`` of the true pairs (q, node) lies in at least one ordering."""
    ranks = ordered.select("ordering", "node", "rank")
    at = true.select("q", "node").join(ranks, "node").join(ranks.select("ordering", F.col("node").alias("q"), F.col("rank").alias("_q")), ["ordering", "q"])
    gaps = [r["gap"] for r in at.groupBy("q", "node").agg(F.min(F.abs(F.col("rank") - F.col("_q"))).alias("gap")).collect()]
    return int(np.quantile(gaps, recall, method="higher")) if gaps else 0


def _windows(ordered: DataFrame, wanted: DataFrame, window: int, block: int, k: int, dim: int, dtype) -> DataFrame:
    """Nearest nodes of the wanted nodes in the blocks of their windows, ordering by ordering.

    Rows of a block come first and then the queries whose windows reach it, so a task holds one block
    and a batch of queries, whatever the number of queries.
    """
    reach = -(-window // block)
    rows = ordered.withColumn("block", F.expr(f"rank DIV {block}"))
    ends = F.broadcast(rows.groupBy("ordering").agg(F.max("block").alias("_last")))  # one row per ordering
    queries = rows.join(wanted, "node", "left_semi").join(ends, "ordering")
    blocks = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.col("_last")))).alias("block")
    both = rows.select("ordering", "block", F.lit(0).alias("kind"), "node", "least", "v").unionByName(queries.select("ordering", blocks, F.lit(1).alias("kind"), "node", "least", "v"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, vectors, whole = None, [], [], None
        for batch in batches:
            o, b, kind, node, least = (batch.column(i).to_numpy() for i in range(5))
            matrix = unpacked(batch.column("v"), dim, dtype)
            edges = np.flatnonzero((o[1:] != o[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(node)]):
                if lo == hi:
                    continue
                if (o[lo], b[lo]) != key:
                    key, rows, vectors, whole = (o[lo], b[lo]), [], [], None
                if not kind[lo]:
                    rows.append(np.stack((node[lo:hi], least[lo:hi])))
                    vectors.append(matrix[lo:hi].astype(np.float64))
                    continue
                if whole is None:
                    whole = np.concatenate(rows, axis=1), np.concatenate(vectors)
                for at in range(lo, hi, BLOCK):
                    some = slice(at, min(at + BLOCK, hi))
                    yield _hits(node[some], matrix[some].astype(np.float64), *whole[0], whole[1], k)

    # Blocks are all of one size and windows of one width, so no key is hot.
    return both.repartition("ordering", "block").sortWithinPartitions("ordering", "block", "kind", "node").mapInArrow(look, _HITS_SQL)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS,
    dims: int = DIMS, block: int = BLOCK, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found of every query row, by Euclidean distance.

    ``is_query`` is a condition on ``id``. Vectors that are null, zero or hold null or non-finite entries and rows without id take no part. A vector shorter than the
    longest counts as ending in zeros. Repeated rows of one id and vector are one row; a query with several vectors has results for each of them;
    rows with the query's own id are none of its candidates. Fewer than ``k`` candidates are all returned. Extra columns are ignored.
    """
    rows, nodes, dim = _nodes(vectors, id_col, vector_col, k)
    n = nodes.count()
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    dtype = np.float32 if single else np.float64
    dim = max(dim, 1)
    curves = fit_curves(_matrix(_sample(nodes, n, min(FIT_ROWS, FIT_BYTES // (8 * dim)), "directions"), dim)[1], orderings, dims)
    ordered = _ordered(nodes, curves, dim, dtype)
    sampled, points = _matrix(_sample(nodes, n, SAMPLE, "window"), dim)
    true = settle(_true_nearest(nodes, sampled, points, k + 1).where("q <> node"))
    window = window_for(ordered, true, recall)
    asked = rows.where(is_query).distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    asked = settle(asked.select(F.col("id").alias("query_id"), "node"))
    found = _nearest_of(_windows(ordered, asked.select("node").distinct(), window, block, k + 1, dim, dtype), k + 1)
    ids = found.join(nodes.select("node", "ids"), "node").select("q", "distance", F.explode("ids").alias("id"))
    order = W.partitionBy("q").orderBy("distance", "id")
    near = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    lists = settle(near.groupBy(F.col("q").alias("node")).agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near")))
    discard(true)
    own = F.slice(F.filter("near", lambda e: e.id != F.col("query_id")), 1, k)
    return asked.join(lists, "node").select("query_id", F.posexplode(own).alias("_at", "_e")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_e.id").alias("vec_id"), F.col("_e.distance").alias("score"))


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    """The ten nearest other rows of every embedding whose id is divisible by 100."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
