"""Document fingerprints from content-defined chunks.

A text is cut at borders that its own bytes choose (``chunking``), so an insertion
shifts no border but those next to it. Its fingerprint is the set of its chunk digests,
each weighted by the chunk's length; the likeness of one to another is the share of
its weight that the other contains. Fingerprints need the text alone: one map pass.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import cut_points
from .text import _BYTE_VALUES, BLOCK_BYTES, blocks, documents, read, record, run_hashes

LEAST, NORMAL, MOST = 16, 48, 192  # bytes; a length fits in the low byte of an entry


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct entries of each text: 56 bits of digest, then 8 bits of length."""
    cuts = cut_points(texts, LEAST, NORMAL, MOST)
    lengths = np.concatenate([np.diff(c, prepend=0) for c in cuts]) if cuts else np.zeros(0, np.int64)
    a = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum(lengths) - lengths
    h = run_hashes(_BYTE_VALUES[a], first, lengths)
    h = (h & np.uint64(0xFFFFFFFFFFFFFF00)) | lengths.astype(np.uint64)
    out, lo = [], 0
    for c in cuts:
        out.append(np.unique(h[lo:lo + len(c)]))
        lo += len(c)
    return out


def to_string(entries: np.ndarray) -> str:
    return base64.b64encode(entries.astype(">u8").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Share of the weight of ``own`` that ``other`` contains, 0 to 1; two empty fingerprints are alike."""
    if not len(own):
        return float(not len(other))
    weights = own & np.uint64(255)
    return float(weights[np.isin(own, other, assume_unique=True)].sum() / weights.sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; null is the empty text, whose fingerprint is the empty string.

    Equal texts have equal fingerprints; rows may repeat; extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield record({"doc_id": part.column("doc_id"), "fingerprint": [to_string(d) for d in digests(texts)]}, schema)

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows dealt to ranges of doc_id, ready to be read next to their successor in descending order.

    Each range (``_b``) also gets, marked ``_tail``, the row that follows its last one:
    the head of the next range, or for the lowest range the very first row. Rows without
    doc_id come last; rows of one doc_id are ordered by text. One shuffle of the texts;
    the driver sees one number per range.
    """
    spark, rows = docs.sparkSession, documents(docs)
    buckets = buckets or min(10_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / buckets for i in range(1, buckets)]
    bounds = np.unique(rows.agg(F.percentile_approx("doc_id", at, 100_000)).first()[0] or [])

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        places = np.searchsorted(bounds, ids.to_numpy(), side="right") if len(bounds) else np.zeros(len(ids), np.int64)
        return pd.Series(places.astype(np.int32))

    # Nulls are taken out before pandas sees the ids: a null among them would make the others floating point numbers.
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket(F.coalesce("doc_id", F.lit(0).cast("long"))))
    placed = rows.select(place.alias("_b"), "doc_id", "text")
    heads = sorted(((r["_b"], r.head) for r in placed.groupBy("_b").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    # The head of each range follows the last row of the range before it in descending order.
    following = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    tail = spark.createDataFrame(following, "_head long, _to int")
    tails = (
        rows.join(F.broadcast(tail), F.col("doc_id").eqNullSafe(F.col("_head")))  # at most one row per range
        .groupBy("_to", "doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    )
    both = placed.select("_b", F.lit(False).alias("_tail"), "doc_id", "text").unionByName(
        tails.select(F.col("_to").alias("_b"), F.lit(True).alias("_tail"), "doc_id", "text"))
    order = ["_b", "_tail", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")).desc()]
    return both.repartition("_b").sortWithinPartitions(*order)


_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many of the next text's first."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and against the next document's."""

    def report(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """All texts but the last, each with its successor."""
        plain = [t.decode() for t in texts]
        edited = [edited_text(a, b).encode() for a, b in zip(plain, plain[1:])]
        own, new = digests(texts), digests(edited)
        return record({
            "doc_id": ids, "n_chars": [len(t) for t in plain[:-1]],
            "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
            "fingerprint": [to_string(d) for d in own[:-1]], "edited_fingerprint": [to_string(d) for d in new],
            "near_edited": [containment(a, b) for a, b in zip(own, new)], "near_next": [containment(a, b) for a, b in zip(own, own[1:])],
        }, _EDITED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for part, new in blocks(batches):
            rows = zip(part.column("doc_id").to_pylist(), new, part.column("_tail").to_pylist())
            for doc_id, text, tail in rows:
                texts.append(text)
                size += len(text)
                if tail or size > BLOCK_BYTES and len(texts) > 1:
                    # ids holds one entry less when the last text only serves as a successor
                    yield report(ids[:len(texts) - 1], texts)
                    ids, texts, size = ([], [], 0) if tail else ([doc_id], [text], len(text))
                else:
                    ids.append(doc_id)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return compare_edited(read(spark, sf_dir, "documents"))
