"""Words, hashes and batches for the operators that read whole texts inside Arrow tasks.

Texts are handled as UTF-8 bytes, many at a time, in numpy. A block holds about
``BLOCK_BYTES`` of text (one longer text makes a block by itself), so memory does
not depend on the size of a table or of a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BATCH_ROWS = 1000
_K1, _K2, _BASE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_table(is_word, fold=None) -> bytes:
    """256-byte table for ``bytes.translate``: separators become a space, word bytes ``fold(byte)``."""
    return bytes((fold(b) if fold else b) if is_word(b) else 32 for b in range(256))


#: Words between ASCII white space, unchanged.
PLAIN = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
#: ASCII letters folded to lower case; words are letters, digits and all non-ASCII characters.
FOLDED = byte_table(lambda b: b >= 128 or chr(b).isalnum(), lambda b: b + 32 if 65 <= b <= 90 else b)


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _K1
    h ^= h >> np.uint64(33)
    h *= _K2
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = _powers(64, _BASE)


def run_hashes(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``values[first : first + length]``; runs lie end to end, none is empty."""
    global _pow
    if not len(first):
        return np.zeros(0, np.uint64)
    if (most := int(lengths.max())) > len(_pow):
        _pow = _powers(2 * most, _BASE)
    within = np.arange(len(values)) - np.repeat(first, lengths)
    h = np.add.reduceat(values * _pow[within], first)
    return mix(h + lengths.astype(np.uint64) * _K2)


class Words:
    """Words of a block of texts: hashes, byte places in ``raw`` and, per text, the range of its words."""

    def __init__(self, texts: list[bytes], table: bytes = PLAIN):
        self.raw = b" ".join(texts) + b" "
        self.folded = self.raw.translate(table)
        a = np.frombuffer(self.folded, np.uint8)
        inside = a != 32
        self.start, self.end = self._borders(a, inside)
        lengths = self.end - self.start
        first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        self.hash = run_hashes(_BYTE_VALUES[a[inside]], first, lengths)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.offsets = np.searchsorted(self.start, self.text_start)

    @staticmethod
    def _borders(a: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        return edge[0::2], edge[1::2]

    def __len__(self) -> int:
        return len(self.hash)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def word(self, i: int) -> bytes:
        return self.folded[self.start[i]:self.end[i]]


_PUNCTUATION = np.array([33 <= b < 128 and not chr(b).isalnum() for b in range(256)])


class Pieces(Words):
    """Like ``Words``, with runs of ASCII punctuation split from the words they stand at."""

    @staticmethod
    def _borders(a: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = inside.astype(np.int8) + _PUNCTUATION[a]
        edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(a)]))
        some = kind[edge[:-1]] > 0
        return edge[:-1][some], edge[1:][some]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(_BASE)
        out += h[j:len(h) - n + 1 + j]
    return mix(out ^ np.uint64(n))


def inside_text(words: Words, n: int) -> np.ndarray:
    """For each place of ``gram_hashes``: whether its n words belong to one text."""
    owner = words.text_of()
    return owner[:len(owner) - n + 1] == owner[n - 1:] if len(owner) >= n else np.zeros(0, bool)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with the bytes of their texts, about ``BLOCK_BYTES`` each."""
    for batch in batches:
        lo = size = 0
        column = batch.column(text)
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)) if len(column) else []
        for i, n in enumerate(sizes):
            size += int(n) + 1
            if size >= BLOCK_BYTES or i + 1 == len(column):
                part = batch.slice(lo, i + 1 - lo)
                yield part, as_bytes(part.column(text))
                lo, size = i + 1, 0


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, and the next stage's tables come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def small_batches(spark) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows: texts are wide rows, and both sides of a Python task hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under the names ``doc_id`` (long) and ``text``: extra columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keyed(df: DataFrame) -> DataFrame:
    """``documents`` with ``_key``: rows that repeat an id with another text stay apart, equal rows share a key."""
    return df.withColumn("_key", F.xxhash64("doc_id", "text"))


def hex_of(bits: np.ndarray) -> list[str]:
    return [f"{int(b):016x}" for b in bits]


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
