"""Toxicity by class-conditional models of word prefixes with absolute discounting.

Words are spelled in steps of growing prefixes (4, 6, 8 bytes, the whole word), so that
inflected and compounded forms share evidence with their stems. Two models, one of toxic and
one of ordinary documents, give every step a probability after its prefix: counts are
discounted absolutely, and what the discount takes is spread over the steps by one backoff
distribution that both classes share. A rare expression thus gets nearly the same probability from both and
says little, while one typical of a class says much. A word is conditioned on its own prefixes only, never on
the words before it, so expressions made of ordinary words give no evidence. The score compares the length-normalised
log-likelihoods of both models, over the whole document and over its most telling windows of eight words.

Class counts come from every usable labelled document but those that fit the curve, the shared backoff
from all documents. They are kept in hash tables of fixed
size (``NODE_BITS``), so the model that is sent to the executors does not grow with the
corpus; steps that share a bucket add up. A logistic curve over the comparisons is fitted on a bounded sample of
labelled rows, the only ones that the class counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import broadcast_checked, discard, settle
from .quality import curve, scored
from .text import FOLDED, Words, blocks, crc_mod, documents, give_back, mix, read, record, small_batches

NODE_BITS = 21
PREFIXES = (4, 6, 8)  # bytes
DISCOUNT = 4.0
SPAN = 8
MAX_FIT_ROWS = 20_000
CALIBRATION = 8  # every eighth labelled document, but no more than the bound, fits the curve and not the counts
MAX_HELD = 250_000
_PART = 14
_ROOT, _WHOLE = np.uint64(0x6A09E667F3BCC908), np.uint64(0x5851F42D4C957F2D)


def _bucket(node: np.ndarray) -> np.ndarray:
    return (node >> np.uint64(64 - NODE_BITS)).astype(np.int64)


def _steps(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, prefix, node) of every step; prefix and node are hashes, the first prefix is empty."""
    raw = np.frombuffer(w.folded, np.uint8)
    size = w.end - w.start
    grown = np.zeros(len(w), np.uint64)
    parent = np.full(len(w), _ROOT)
    words, parents, nodes = [], [], []
    at = np.arange(len(w))
    done = 0
    for n in PREFIXES:
        on = size[at] > n  # longer words go on, the others end here with their whole form
        for j in range(done, n):
            inside = j < size[at]
            grown[at] += np.where(inside, mix(raw[np.minimum(w.start[at] + j, len(raw) - 1)].astype(np.uint64) + np.uint64(256 * (j + 1))), np.uint64(0))
        done = n
        node = np.where(on, mix(grown[at] + np.uint64(n)), w.hash[at] ^ _WHOLE)
        words.append(at)
        parents.append(parent[at])
        nodes.append(node)
        parent[at] = node
        at = at[on]
    return np.concatenate([*words, at]), np.concatenate([*parents, parent[at]]), np.concatenate([*nodes, w.hash[at] ^ _WHOLE])


_COUNTS = pa.schema([("node", pa.int64()), ("parent", pa.int32()), ("toxic", pa.int32()), ("ordinary", pa.int32()), ("every", pa.int32())])


def _node_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, parent, toxic, ordinary, every): occurrences of every step in either class of ``labels`` (doc_id, label), and in all documents."""

    def summed(node, parent, *counts):
        node, first, at = np.unique(np.concatenate(node), return_index=True, return_inverse=True)
        return node, np.concatenate(parent)[first], *(np.bincount(at, np.concatenate(n), minlength=len(node)).astype(np.int32) for n in counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part, texts in blocks(batches):
            w = Words(texts, FOLDED)
            word, parent, node = _steps(w)
            label = part.column("label").to_numpy()[w.text_of()[word]]
            held.append(summed([node.view(np.int64)], [_bucket(parent).astype(np.int32)], [label == 1], [label == 0], [np.ones(len(label))]))
            if sum(len(h[0]) for h in held) > MAX_HELD:
                yield record(dict(zip(_COUNTS.names, summed(*zip(*held)))), _COUNTS)
                held = []
        if held:
            yield record(dict(zip(_COUNTS.names, summed(*zip(*held)))), _COUNTS)
        give_back()

    # Labels are joined where the texts lie while they are few; beyond that by a shuffle.
    rows = documents(docs).join(broadcast_checked(labels, 2_000_000), "doc_id", "left").select("text", F.coalesce("label", F.lit(-1)).alias("label"))
    counts = rows.mapInArrow(emit, "node long, parent int, toxic int, ordinary int, every int")
    return counts.groupBy("node", "parent").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "every")])


def _dense(table: DataFrame, columns: list[str]) -> list[list[tuple[int, bytes]]]:
    """Columns of (bucket, ...) as parts (number, packed floats) of tables of 2**NODE_BITS; parts without rows are left out.

    Tasks pack them, as most buckets of a small corpus are empty, and the driver passes them on as they are.
    """
    width = 1 << _PART

    def pack(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket").to_numpy()
        out = {"part": rows.column("part").slice(0, 1)}
        for c in columns:
            values = np.zeros(width, np.float32)
            values[bucket & (width - 1)] = rows.column(c).to_numpy()
            out[c] = [zstandard.ZstdCompressor(1).compress(values.tobytes())]
        return pa.table(out)

    packed = table.withColumn("part", F.shiftright("bucket", _PART).cast("int")).groupBy("part").applyInArrow(pack, "part int, " + ", ".join(f"{c} binary" for c in columns))
    rows = packed.collect()  # 2**NODE_BITS numbers per column at most, whatever the corpus
    return [[(r["part"], bytes(r[c])) for r in rows] for c in columns]


def fit_counts(docs: DataFrame, labels: DataFrame) -> dict[str, list[tuple[int, bytes]]]:
    """Hashed count tables, in packed parts, of both classes from rows labelled 1 (toxic) or 0, and of all documents.

    Both classes discount the same rate: ``DISCOUNT`` occurrences in the smaller class and
    in proportion more in the larger one. So a step that is rare in both backs off in
    both, whatever their sizes.
    """
    nodes = settle(_node_counts(docs, labels))
    classes = ("toxic", "ordinary")
    total = nodes.where(F.col("parent") == int(_bucket(_ROOT))).agg(*[F.sum(c).alias(c) for c in classes]).first().asDict()
    least = max(1.0, min(float(n or 0) for n in total.values()))
    discount = {c: DISCOUNT * max(1.0, float(n or 0) / least) for c, n in total.items()}
    left = {c: F.greatest(F.col(c) - discount[c], F.lit(0.0)) for c in classes}
    bucket = F.shiftrightunsigned("node", 64 - NODE_BITS).alias("bucket")
    out: dict[str, list[tuple[int, bytes]]] = {}
    own = nodes.groupBy(bucket).agg(*[F.sum(left[c]).alias(c) for c in classes], F.sum("every").alias("shared"))
    out["left_toxic"], out["left_ordinary"], out["shared"] = _dense(own, [*classes, "shared"])
    below = nodes.groupBy(F.col("parent").cast("long").alias("bucket")).agg(*[F.sum(c).alias(c) for c in classes], *[F.sum(F.col(c) - left[c]).alias(f"{c}_taken") for c in classes], F.sum("every").alias("every"))
    names = [*classes, "toxic_taken", "ordinary_taken", "every"]
    for name, values in zip(names, _dense(below, names)):
        out[f"below_{name}"] = values
    discard(nodes)
    return out


class Models:
    """Log-likelihood ratio per word from the count tables."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.counts = counts

    def ratios(self, w: Words) -> np.ndarray:
        word, parent, node = _steps(w)
        parent, node = _bucket(parent), _bucket(node)
        shared = (self.counts["shared"][node] + 0.5) / (self.counts["below_every"][parent] + 1.0)
        log = []
        for c in ("toxic", "ordinary"):
            n, taken = self.counts[f"below_{c}"][parent], self.counts[f"below_{c}_taken"][parent]
            # Buckets may be shared: what is left of a step is at most what is left below its prefix.
            left = np.minimum(self.counts[f"left_{c}"][node], n - taken)
            log.append(np.log(np.where(n > 0, (left + taken * shared) / np.maximum(n, 1), shared)))
        return np.bincount(word, log[0] - log[1], minlength=len(w))

    def compare(self, texts: list[bytes]) -> np.ndarray:
        """Per text: mean log ratio of all words, best and second best window's mean, and 1 / (1 + words)."""
        w = Words(texts, FOLDED)
        out = np.zeros((len(texts), 4))
        n = np.diff(w.offsets)
        out[:, 3] = 1 / (1 + n)
        if not len(w):
            return out
        ratio = self.ratios(w)
        owner = np.repeat(np.arange(len(texts)), n)
        out[:, 0] = np.bincount(owner, ratio, minlength=len(texts)) / np.maximum(n, 1)
        # Windows of SPAN words, those at the end of a text being shorter, each normalised by SPAN.
        grown = np.concatenate(([0], np.cumsum(ratio)))
        end = np.cumsum(n)[owner]
        window = (grown[np.minimum(np.arange(len(ratio)) + SPAN, end)] - grown[:-1]) / SPAN
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        best = np.maximum.reduceat(window, first)
        out[some, 1] = best
        # The second best does not overlap the best.
        at = np.flatnonzero(window == np.repeat(best, n[some]))
        leader = at[np.unique(owner[at], return_index=True)[1]]
        near = np.abs(np.arange(len(window)) - np.repeat(leader, n[some])) < SPAN
        out[some, 2] = np.maximum(np.maximum.reduceat(np.where(near, -np.inf, window), first), -1.0)
        return out


def _inputs(f: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(f)), f[:, 0], f[:, 1], f[:, 2], f[:, 3], np.log(f[:, 3])))


class Model:
    """Fitted tables, sent to the executors once in the packed parts that tasks made of them, and the curve.

    ``fitted`` tells whether labelled rows of both classes reached the curve. Without, scores mean nothing.
    """

    def __init__(self, spark, counts: dict[str, list[tuple[int, bytes]]]):
        self.tables = spark.sparkContext.broadcast(counts)
        self.beta = np.zeros(6)
        self.fitted = False

    def load(self) -> Models:
        """The tables, unpacked one by one for one task: a worker that is used again keeps nothing."""
        unpack = zstandard.ZstdDecompressor().decompress
        out = {}
        for name, parts in self.tables.value.items():
            table = out[name] = np.zeros((1 << (NODE_BITS - _PART), 1 << _PART), np.float32)
            for part, packed in parts:
                table[part] = np.frombuffer(unpack(packed), np.float32)
        return Models({name: table.ravel() for name, table in out.items()})

    def scores(self, models: Models, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(models.compare(texts)) @ self.beta, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Count tables from the usable labelled rows, and the curve from about ``max_rows`` of them at most (an eighth of few), which are left out.

    A doc_id with several labels counts with the greatest of them; null ids and labels other than 0 and 1 do not count.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    own = own.where(usable & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1 / CALIBRATION, max_rows / max(1, own.count()))
    apart = F.pmod(F.xxhash64(F.lit("curve"), F.col("doc_id")), F.lit(1 << 40)) < int(share * (1 << 40))
    model = Model(docs.sparkSession, fit_counts(docs, own.where(~apart)))
    schema = pa.schema([("label", pa.int32()), *((f"f{i}", pa.float64()) for i in range(4))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = model.load()
        for part, texts in blocks(batches):
            f = models.compare(texts)
            yield record({"label": part.column("label"), **{f"f{i}": f[:, i] for i in range(4)}}, schema)
        del models
        give_back()

    # About max_rows rows of two numbers, whatever the number of labels.
    rows = documents(docs).join(F.broadcast(own.where(apart)), "doc_id").select("text", "label").mapInArrow(compare, "label int, f0 double, f1 double, f2 double, f3 double").toArrow()
    if len(rows):
        y = rows.column("label").to_numpy().astype(float)
        model.beta = curve(_inputs(np.column_stack([rows.column(f"f{i}").to_numpy() for i in range(4)])), y)
        model.fitted = len(np.unique(y)) == 2
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, 0 to 1; null and empty texts have no evidence but their length. Rows may repeat."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = model.load()
        for part, texts in blocks(batches):
            yield record({"doc_id": part.column("doc_id"), "score": model.scores(models, texts)}, schema)
        del models
        give_back()

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Rows of ``docs`` (with a text column) whose score is below ``threshold``; all columns, one map pass.

    All rows if the model is not fitted: nothing is known against them.
    """
    if not model.fitted:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = model.load()
        for part, texts in blocks(batches):
            yield part.filter(pa.array(model.scores(models, texts) < threshold))
        del models
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows outside the held-out quarter."""
    docs, held_out = read(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    return scored(score(docs, fit(docs, read(spark, sf_dir, "labels"), ~held_out)), held_out)
