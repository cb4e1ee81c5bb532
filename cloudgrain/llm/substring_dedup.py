"""Substring dedup: words covered by a window that an earlier document also has.

Windows of 13 words are dealt to shards by content: neighbouring windows with the
same minimiser (least hash of their 5-word grams) form one super-window, and equal
windows always share a minimiser, so they meet in the same shard wherever they
come from. Each shard keeps a compact FM-index of its distinct super-windows
(``fm_index``); streaming them through backward search gives matching statistics,
and intervals of full window length report the least doc_id that has the window.

What keeps it in proportion to the input:

- Super-windows whose minimiser occurs in one document only cannot repeat. A bit map of
  fixed size, built from all minimisers, passes the rest (and, by collisions, a few more:
  that costs time, never rows). ``filter_bits`` should grow with the corpus.
- Copies of one super-window are combined before they reach a shard.
- A minimiser with many contexts (a common line in different surroundings) would fill a
  shard. Those are marked in a second bit map, and their windows are dealt out one by one, by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, settle
from .filters import bit_maps, has
from .fm_index import FMIndex
from .text import PLAIN, Words, blocks, documents, gram_hashes, inside_text, keyed, mix, read, record

WINDOW, GRAM = 13, 5
FILTER_BITS = 27
HOT_RUNS = 4096  # super-windows of one minimiser in one shard, at most
LONGEST_RUN = 64  # windows
SHARD_WORDS = 1 << 18
WORD_BYTES = 5  # of a word's hash that travel and are compared
MAX_HELD = 500_000


def _super_windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of every super-window of a block."""
    least = gram_hashes(w.hash, GRAM)
    span, width = WINDOW - GRAM + 1, 1
    if len(w) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[:width - span], least[span - width:])
    at = np.flatnonzero(inside_text(w, WINDOW))
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    start = np.flatnonzero(place % LONGEST_RUN == 0)
    return at[start], np.diff(np.append(start, len(at))), key[start]


def _filters(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit maps of the minimisers that several documents have and of those with many super-windows; number of super-windows of the former."""
    schema = pa.schema([("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            w = Words(texts, PLAIN)
            first, _, key = _super_windows(w)
            if not len(key):
                continue
            doc = part.column("doc_id").to_numpy()[w.text_of()[first]]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            yield record({"key": key[start].astype(np.int64), "low": doc[start], "high": doc[start + size - 1], "n": size}, schema)

    seen = rows.mapInArrow(emit, "key long, low long, high long, n long")
    several = seen.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high")
    several = settle(several)
    place = F.shiftrightunsigned("key", 64 - bits)
    maps = bit_maps(several, place, bits, {"any": F.lit(True), "hot": F.col("n") > HOT_RUNS})
    n_runs = several.agg(F.sum("n").alias("n")).first().n or 0
    discard(several)
    return maps["any"], maps["hot"], n_runs


def _has(bit_map: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    return has(bit_map, (key >> np.uint64(64 - bits)).astype(np.int64))


def _runs(part: pa.RecordBatch, w: Words, filters: tuple[np.ndarray, np.ndarray], bits: int) -> dict[str, np.ndarray]:
    """Super-windows of a block that may repeat. ``at``: first word in the block, ``n``: windows, (h1, h2): 128 bits that name it."""
    several, hot = filters
    at, n, key = _super_windows(w)
    keep = _has(several, key, bits)
    at, n, key = at[keep], n[keep], key[keep]
    single = _has(hot, key, bits)
    times = np.where(single, n, 1)
    offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, n, key, single = np.repeat(at, times) + offset, np.where(single, 1, n).repeat(times), np.repeat(key, times), np.repeat(single, times)
    text = np.searchsorted(w.offsets, at, side="right") - 1
    names = []
    for salt in (1, 2):
        grown = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(mix(w.hash ^ np.uint64(salt)) * _odd(len(w), salt), out=grown[1:])
        names.append(mix((grown[at + n + WINDOW - 1] - grown[at]) * _inverse(at, salt) + n.astype(np.uint64)).astype(np.int64))
    return {
        "_key": part.column("_key").to_numpy()[text], "doc_id": part.column("doc_id").to_numpy()[text], "first": (at - w.offsets[text]).astype(np.int32),
        "h1": names[0], "h2": names[1], "at": at, "n": n, "deal": np.where(single, names[0], key.astype(np.int64)),
    }


_DISTINCT = pa.schema([("shard", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("words", pa.binary())])
_PLACES = pa.schema([("_key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _distinct_runs(rows: DataFrame, shared, bits: int, shards: int) -> DataFrame:
    """Super-windows with their words and range of doc_id, each once per partition (or per ``MAX_HELD`` of them)."""

    def packed(held: dict) -> pa.RecordBatch:
        columns = list(zip(*held.values())) if held else [[]] * 4
        return record({"h1": [k[0] for k in held], "h2": [k[1] for k in held], "shard": columns[0], "low": columns[1], "high": columns[2], "words": columns[3]}, _DISTINCT)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for part, texts in blocks(batches):
            w = Words(texts, PLAIN)
            r = _runs(part, w, shared.value, bits)
            view = memoryview(np.ascontiguousarray(w.hash.view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES:])).cast("B")
            r["shard"] = (mix(r["deal"].view(np.uint64)) % np.uint64(shards)).astype(np.int32)
            for h1, h2, shard, doc, at, n in zip(*(r[c].tolist() for c in ("h1", "h2", "shard", "doc_id", "at", "n"))):
                have = held.get((h1, h2))
                if have is None:
                    held[h1, h2] = [shard, doc, doc, bytes(view[WORD_BYTES * at:WORD_BYTES * (at + n + WINDOW - 1)])]
                elif doc < have[1]:
                    have[1] = doc
                elif doc > have[2]:
                    have[2] = doc
            if len(held) > MAX_HELD:
                yield packed(held)
                held = {}
        yield packed(held)

    return rows.mapInArrow(emit, "shard int, h1 long, h2 long, low long, high long, words binary")


def _places(rows: DataFrame, shared, bits: int) -> DataFrame:
    """Where each super-window stands."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield record(_runs(part, Words(texts, PLAIN), shared.value, bits), _PLACES)

    return rows.mapInArrow(emit, "_key long, doc_id long, first int, n int, h1 long, h2 long")


_BASES = {1: (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)), 2: (0xD1B54A32D192ED03, pow(0xD1B54A32D192ED03, -1, 1 << 64))}
_grown: dict[tuple[int, int], np.ndarray] = {}


def _power_table(n: int, salt: int, which: int) -> np.ndarray:
    have = _grown.get((salt, which))
    if have is None or len(have) < n:
        base = np.full(max(2 * n, 1 << 18), _BASES[salt][which], np.uint64)
        base[0] = 1
        have = _grown[salt, which] = np.multiply.accumulate(base)
    return have


def _odd(n: int, salt: int) -> np.ndarray:
    return _power_table(n, salt, 0)[:n]


def _inverse(at: np.ndarray, salt: int) -> np.ndarray:
    return _power_table(int(at.max(initial=0)) + 1, salt, 1)[at]


def _search_shard(table: pa.Table) -> pa.Table:
    """Least doc_id of every window of a shard's distinct super-windows.

    Windows of one owner are written once. A super-window of one document that owns all its windows is left out.
    """
    h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
    order = np.lexsort((h2, h1))
    start = np.flatnonzero(np.concatenate(([True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0))))
    low = np.minimum.reduceat(table.column("low").to_numpy()[order], start)
    high = np.maximum.reduceat(table.column("high").to_numpy()[order], start)
    column = table.column("words").combine_chunks().take(pa.array(order[start]))
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WORD_BYTES)
    values = np.zeros((len(raw), 8), np.uint8)
    values[:, :WORD_BYTES] = raw
    values = values.view(np.uint64).ravel()
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)).astype(np.int64) // WORD_BYTES
    index = FMIndex(values, sizes, low, WINDOW)
    length, row = index.matching_statistics(values, sizes)
    owner = index.least_owner[row]
    first = np.cumsum(sizes) - sizes
    names1, names2, owners = [], [], []
    for k, (a, n) in enumerate(zip(first.tolist(), (sizes - WINDOW + 1).tolist())):
        own = owner[a:a + n]
        assert (length[a:a + n] == WINDOW).all()  # every window of the index is found in it
        same = (own == own[0]).all()
        if same and own[0] == high[k]:
            continue
        names1.append(h1[order[start[k]]])
        names2.append(h2[order[start[k]]])
        owners.append(own[:1 if same else n].tobytes())
    return pa.table({"h1": pa.array(names1, pa.int64()), "h2": pa.array(names2, pa.int64()), "owners": pa.array(owners, pa.binary())})


def repeated_windows(rows: DataFrame, filter_bits: int = FILTER_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(_key, starts): first words of the windows of each row that an earlier document has, as packed 32-bit numbers."""
    rows = rows.where("doc_id IS NOT NULL")
    several, hot, n_runs = _filters(rows, filter_bits)
    shared = rows.sparkSession.sparkContext.broadcast((several, hot))  # 2 * 2**filter_bits bits, whatever the corpus
    shards = max(1, -(-n_runs * (WINDOW + 4) // shard_words))
    owners = _distinct_runs(rows, shared, filter_bits, shards).groupBy("shard").applyInArrow(_search_shard, "h1 long, h2 long, owners binary")
    schema = pa.schema([("_key", pa.int64()), ("starts", pa.binary())])

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts = [], []
            for key, doc, first, n, packed in zip(*(batch.column(c).to_pylist() for c in ("_key", "doc_id", "first", "n", "owners"))):
                own = np.frombuffer(packed, np.int64)
                again = (np.flatnonzero(own < doc) if len(own) > 1 else np.arange(n if own[0] < doc else 0)) + first
                if len(again):
                    keys.append(key)
                    starts.append(again.astype(np.int32).tobytes())
            yield record({"_key": keys, "starts": starts}, schema)

    # A super-window of many documents is a hot key here; a plain join lets AQE split it.
    met = _places(rows, shared, filter_bits).join(owners, ["h1", "h2"])
    return met.select("_key", "doc_id", "first", "n", "owners").mapInArrow(earlier, "_key long, starts binary")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))), ("kept_text", pa.string())])


def remove_repeats(docs: DataFrame, filter_bits: int = FILTER_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: n_words, n_removed, removed word ranges and the kept words joined by one space.

    A word goes if a window of 13 words that covers it also starts in a document of
    smaller doc_id. Null and empty texts have no words. Rows of equal doc_id never
    remove from each other; rows without doc_id lose nothing and remove nothing.
    Word sequences are compared word by word by 40-bit hashes. Extra columns are ignored.
    """
    rows = keyed(documents(docs))
    starts = repeated_windows(rows, filter_bits, shard_words).groupBy("_key").agg(F.collect_list("starts").alias("starts"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            out = {k: [] for k in ("n_words", "n_removed", "removed", "kept_text")}
            for text, packed in zip(texts, part.column("starts").to_pylist()):
                words = text.split()
                ranges = []
                if packed:
                    covered = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in packed]))
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + WINDOW, -1)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered) > 0).astype(np.int8))))).reshape(-1, 2).tolist()
                    ranges = [{"first": a, "n": b - a} for a, b in edge]
                    kept = [w for lo, hi in zip([0, *[b for _, b in edge]], [*[a for a, _ in edge], len(words)]) for w in words[lo:hi]]
                else:
                    kept = words
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["removed"].append(ranges)
                out["kept_text"].append(b" ".join(kept).decode())
            yield record(out | {"doc_id": part.column("doc_id")}, _KEPT)

    return rows.join(starts, "_key", "left").select("doc_id", "text", "starts").mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,n:int>>, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the passages that earlier documents have, in digests."""
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (h) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.p) AS text FROM placed t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
