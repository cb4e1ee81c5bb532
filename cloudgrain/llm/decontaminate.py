"""Benchmark decontamination: a hash set of normalised test n-grams against every training token window.

Windows are ``n`` consecutive normalised words of a benchmark item; an item of
fewer words, but not none, is one window. Documents are scanned once: rolling
window hashes are looked up in the sorted set, hits are verified word by word,
and all words inside a verified window are hit.

The set is broadcast when the benchmark has at most ``max_broadcast_windows``
windows of ``MAX_BROADCAST_BYTES`` together (both are counted first). A larger benchmark is dealt out by window
hash instead: only matching (document, place) rows come back, and the same
verification follows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import FOLDED, Words, as_bytes, blocks, documents, gram_hashes, inside_text, keyed, read, record

WINDOW = 10
MAX_BROADCAST_WINDOWS = 500_000
MAX_BROADCAST_BYTES = 1 << 26  # of words and item ids

_HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, clean_text string"
_WINDOWS = pa.schema([("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())])


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, hash, words, item): every window of every item, ``words`` joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            out = {k: [] for k in _WINDOWS.names}
            w = Words(texts, FOLDED)
            for i, item in enumerate(part.column("item").to_pylist()):
                lo, hi = int(w.offsets[i]), int(w.offsets[i + 1])
                if item is None or hi == lo:
                    continue
                size = min(n, hi - lo)
                for j, h in enumerate(gram_hashes(w.hash[lo:hi], size)):
                    out["n"].append(size)
                    out["hash"].append(int(h.astype(np.int64)))
                    out["words"].append(b" ".join(w.word(k) for k in range(lo + j, lo + j + size)))
                    out["item"].append(item)
            yield record(out, _WINDOWS)

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "n int, hash long, words binary, item string").distinct()


def _lookup(rows) -> tuple[dict[int, np.ndarray], dict]:
    """Sorted hashes per window size, and (size, hash) -> words -> item ids."""
    exact: dict = defaultdict(lambda: defaultdict(list))
    for n, h, words, item in rows:
        exact[n, h][bytes(words)].append(item)
    sizes = sorted({n for n, _ in exact})
    return {n: np.sort(np.array([h for m, h in exact if m == n], np.int64).view(np.uint64)) for n in sizes}, {k: dict(v) for k, v in exact.items()}


def _scan(w: Words, sorted_hashes: dict[int, np.ndarray], exact: dict) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Hit words of a block, and (first word, item) of each verified window."""
    hit = np.zeros(len(w) + 1, np.int64)
    found = []
    for n, known in sorted_hashes.items():
        h = gram_hashes(w.hash, n)
        if not len(h):
            continue
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        for i in np.flatnonzero((known[at] == h) & inside_text(w, n)):
            items = exact[n, int(h[i].astype(np.int64))].get(b" ".join(w.word(k) for k in range(i, i + n)))
            if items:
                hit[i] += 1
                hit[i + n] -= 1
                found += [(int(i), x) for x in items]
    return np.cumsum(hit[:-1]) > 0, found


def _report(doc_ids, w: Words, hit: np.ndarray, found: list[tuple[int, str]]) -> dict:
    out = {k: [] for k in ("doc_id", "n_words", "n_hit", "items", "spans", "clean_text")}
    by_text = defaultdict(set)
    if found:
        owner = np.searchsorted(w.offsets, [i for i, _ in found], side="right") - 1
        for t, (_, item) in zip(owner, found):
            by_text[int(t)].add(item)
    for i, doc_id in enumerate(doc_ids):
        lo, hi = int(w.offsets[i]), int(w.offsets[i + 1])
        own = hit[lo:hi]
        raw = w.raw[w.text_start[i]:w.text_start[i + 1] - 1]
        spans = []
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
            base, pieces, last = int(w.text_start[i]), [], 0
            for a, b in edge.reshape(-1, 2):
                start, end = int(w.start[lo + a]) - base, int(w.end[lo + b - 1]) - base
                spans.append({"start": len(raw[:start].decode()), "end": len(raw[:end].decode())})
                pieces.append(raw[last:start])
                last = end
            raw = b"".join([*pieces, raw[last:]])
        out["doc_id"].append(doc_id)
        out["n_words"].append(hi - lo)
        out["n_hit"].append(int(own.sum()))
        out["items"].append(sorted(by_text.get(i, ())))
        out["spans"].append(spans)
        out["clean_text"].append(raw.decode())
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, hit spans (code points) and the text without them.

    Null texts have no words; a null item id counts as no item. Documents may
    repeat, each row is judged by itself. An empty benchmark hits nothing.
    Extra columns are ignored.
    """
    spark, rows = docs.sparkSession, keyed(documents(docs))
    windows = benchmark_windows(benchmark, n)
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    small = max_broadcast_windows and size["n"] <= max_broadcast_windows and size["bytes"] <= MAX_BROADCAST_BYTES
    schema = T._parse_datatype_string(_HITS)
    arrow = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("clean_text", pa.string()),
    ])
    if small:
        shared = spark.sparkContext.broadcast(_lookup([tuple(r) for r in windows.collect()]))

        def scan(batches):
            for part, texts in blocks(batches):
                w = Words(texts, FOLDED)
                yield record(_report(part.column("doc_id").to_pylist(), w, *_scan(w, *shared.value)), arrow)

        return rows.select("doc_id", "text").mapInArrow(scan, schema)
    return _dealt_out(rows, windows, arrow, schema)


def _dealt_out(rows: DataFrame, windows: DataFrame, arrow: pa.Schema, schema: T.StructType) -> DataFrame:
    """The same result with the set joined by window hash: for benchmarks too large to broadcast."""
    sizes = [r.n for r in windows.select("n").distinct().collect()]  # at most WINDOW values
    places = pa.schema([("_key", pa.int64()), ("n", pa.int32()), ("hash", pa.int64())])

    def emit(batches):
        for part, texts in blocks(batches):
            w, keys = Words(texts, FOLDED), part.column("_key").to_numpy()
            owner = w.text_of()
            for n in sizes:
                ok = inside_text(w, n)
                h = gram_hashes(w.hash, n)[ok].astype(np.int64)
                yield record({"_key": keys[owner[:len(ok)][ok]], "n": np.full(len(h), n, np.int32), "hash": h}, places)

    at = rows.select("_key", "text").mapInArrow(emit, "_key long, n int, hash long")
    # One row per (document, window) that matches by hash; an item's own windows are few.
    found = at.join(windows, ["n", "hash"]).distinct().groupBy("_key").agg(F.collect_list(F.struct("n", "hash", "words", "item")).alias("known"))

    def scan(batches):
        for batch in batches:
            known = batch.column("known").to_pylist()
            for i, text in enumerate(as_bytes(batch.column("text"))):
                w = Words([text], FOLDED)
                hit = _scan(w, *_lookup([(k["n"], k["hash"], k["words"], k["item"]) for k in known[i] or []]))
                yield record(_report(batch.column("doc_id").slice(i, 1).to_pylist(), w, *hit), arrow)

    return rows.join(found, "_key", "left").select("doc_id", "text", "known").mapInArrow(scan, schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """``docs`` without contaminated spans; documents with more than ``max_share`` of their words hit go.

    Keeps the columns of ``docs``; ``n_chars``, if there, follows the new text.
    Rows that repeat a doc_id with other texts are told apart by their text.
    """
    found = contamination(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, n)
    hit = found.where("n_hit > 0").select(
        F.col("doc_id").alias("_key"), F.struct(F.col("clean_text").alias("text"), (F.col("n_hit") > F.col("n_words") * max_share).alias("gone")).alias("_hit"),
    ).dropDuplicates(["_key"])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", "text").alias("_key")).join(hit, "_key", "left")
    text = F.coalesce("_hit.text", "_row.text")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_hit").isNull(), F.col("_row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.where("_hit IS NULL OR NOT _hit.gone").select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by ``benchmark``, in digests."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
