"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words and runs of punctuation, alone and in pairs, are hashed to 2**20 weights; a
document is the unit vector of its damped counts. The leader's per-coordinate steps run
over a bounded sample of labelled rows (``MAX_FIT_ROWS``, chosen by a digest of doc_id)
in ``SHARDS`` tasks whose weights are averaged. Scoring is a sparse dot product per
document in one map pass; the weights it needs have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Pieces, blocks, crc_mod, documents, gram_hashes, inside_text, read, record

BITS = 20
MAX_FIT_ROWS = 20_000
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.002
THRESHOLD = 0.3


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the non-zero features; place 0 is the bias of every text."""
    w = Pieces(texts)
    shift = np.uint64(64 - bits)
    owner = w.text_of()
    pair = gram_hashes(w.hash, 2)
    ok = inside_text(w, 2)
    place = np.concatenate((w.hash >> shift, pair[ok] >> shift)).astype(np.int64)
    place[place == 0] = 1
    key = (np.concatenate((owner, owner[:len(ok)][ok])) << bits) | place
    key, count = np.unique(key, return_counts=True)
    value = np.log1p(count)
    text = key >> bits
    norm = np.sqrt(np.bincount(text, value * value, minlength=len(texts)))
    value = value / norm[text]
    each = np.arange(len(texts))
    return np.concatenate((text, each)), np.concatenate((key & ((1 << bits) - 1), np.zeros(len(texts), np.int64))), np.concatenate((value, np.ones(len(texts))))


def dot(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    text, place, value = features(texts, int(len(weights)).bit_length() - 1)
    return np.bincount(text, weights[place] * value, minlength=len(texts))


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, one example after another."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, place=slice(None)) -> np.ndarray:
        z = self.z[place]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[place])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, place: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(place)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - label) * value
        n = self.n[place]
        new = n + g * g
        self.z[place] += g - (np.sqrt(new) - np.sqrt(n)) / ALPHA * w
        self.n[place] = new


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on a few columns by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        beta += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * beta)
    return beta


def examples(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text."""
    text, place, value = features(texts)
    order = np.argsort(text, kind="stable")
    split = np.cumsum(np.bincount(text, minlength=len(texts)))[:-1]
    return list(zip(np.split(place[order], split), np.split(value[order], split)))


def _shard_models(rows: DataFrame) -> list:
    """(n, weights) of every shard. Texts stream by, epoch after epoch, so a task holds a block of them and its weights."""
    schema = pa.schema([("n", pa.int64()), ("weights", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model, n = None, None, 0

        def done() -> pa.RecordBatch:
            return record({"n": [n], "weights": [model.weights().astype(np.float32).tobytes()]}, schema)

        for part, texts in blocks(batches):
            rows = zip(part.column("_shard").to_pylist(), part.column("_epoch").to_pylist(), part.column("label").to_pylist(), examples(texts))
            for own, epoch, label, example in rows:
                if own != shard:
                    if model is not None:
                        yield done()
                    shard, model, n = own, Ftrl(), 0
                model.learn(*example, label)
                n += epoch == 0
        if model is not None:
            yield done()

    again = rows.select("_shard", F.explode(F.array(*map(F.lit, range(EPOCHS)))).alias("_epoch"), "_order", "doc_id", "label", "text")
    ordered = again.repartition("_shard").sortWithinPartitions("_shard", "_epoch", "_order", "doc_id", "text")
    return ordered.select("_shard", "_epoch", "label", "text").mapInArrow(learn, "n long, weights binary").collect()


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, label, _order): about ``max_rows`` usable labelled rows, chosen by a digest of doc_id.

    A doc_id with several labels has the greatest of them; null ids and labels do not count.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(usable & F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_rows / max(1, own.count()))
    chosen = own.withColumn("_order", F.xxhash64(F.lit(label), F.col("doc_id"))).where(F.pmod("_order", F.lit(1 << 20)) < int(share * (1 << 20)))
    # About max_rows rows of three numbers, whatever the number of labels.
    return documents(docs).join(F.broadcast(chosen), "doc_id")


def _margins(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("label", pa.int32()), ("margin", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield record({"label": part.column("label"), "margin": dot(texts, shared.value)}, schema)

    got = rows.select("text", "label").mapInArrow(run, "label int, margin double").toArrow()
    return got.column("margin").to_numpy(), got.column("label").to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> np.ndarray:
    """Weights from the usable labelled rows; all zero (every score one half) without any.

    Every eighth row of the sample is kept from the leader's steps: a logistic curve over
    its dot products sets the scale and the bias of the averaged weights.
    """
    rows = sample_labelled(docs, labels, label, usable, max_rows).withColumn("_shard", F.pmod(F.shiftright("_order", 20), F.lit(8 * SHARDS)))
    apart = F.col("_shard") < SHARDS
    models = sorted(_shard_models(rows.where(~apart).withColumn("_shard", F.col("_shard") % SHARDS)), key=lambda m: (m.n, m.weights))
    total = sum(m.n for m in models)
    weights = sum((np.frombuffer(m.weights, np.float32) * (m.n / total) for m in models), np.zeros(1 << BITS, np.float32))
    margin, y = _margins(rows.where(apart), weights)
    if len(np.unique(y)) == 2:
        bias, scale = curve(np.column_stack((np.ones(len(y)), margin)), y)
        weights = weights * np.float32(scale)
        weights[0] += np.float32(bias)
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row, 0 to 1; null and empty texts get the bias alone. Rows may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield record({"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-dot(texts, shared.value)))}, schema)

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def scored(rows: DataFrame, held_out: Column) -> DataFrame:
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows outside the held-out fifth."""
    docs, held_out = read(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    return scored(score(docs, fit(docs, read(spark, sf_dir, "labels"), ~held_out)), held_out)
