"""Personal data by bootstrapped contextual extraction.

Base rules find emails, IPv4 addresses, payment cards and phone numbers. These are
the seeds: the words around them become lexical patterns (the two words before; the word before and the
word after; the name that a value is assigned to). Quoted runs of hexadecimal digits are seeds of a further kind, ``secret``, by their shape alone; unlike base
spans they are reported only where a pattern bears them out. Identifier-like tokens that no rule finds are candidates. Patterns and
instances form a graph of two sides, which Spark scores in turn: a pattern is as good for a
kind as the instances it holds, an instance as good as the best pattern that holds it, seeds stay
certain. Patterns with a high score and several different seeds name the candidates
that stand in them. These are seeds themselves in later rounds, so they may bear out new patterns.

Only identifiers and hashes of their surroundings move, never texts. Edges are combined per
task before the shuffle, and every join is a plain equi-join that AQE may split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle
from .text import blocks, documents, read, record

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS = 3
MIN_SCORE = 0.9  # of a pattern that names its instances
MIN_SEEDS = 5  # different seeds of a pattern
REACH = 160  # characters on either side in which the neighbouring words are looked for; of a longer word the part within it counts

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that fails from its first digit fails from the others too, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_SECRET = re.compile(r"[0-9a-fA-F]{32,}")
_ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]{0,63})\s{0,8}[=:]\s{0,8}[\"'`]?\Z")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the base rules find, by start, then kind as listed; code points, end exclusive."""
    found = [(s, "email", e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), "card", m.end()))
        if "+" in text:
            found += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def candidate_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens (five or more characters, a digit or an @) that touch no base span."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out, near = [], iter([*base, (len(text) + 1, "", len(text) + 1)])
    lo, _, hi = next(near)
    for m in _TOKEN.finditer(text):
        token = m[0]
        if len(token) < 5 or not ("@" in token or _DIGIT.search(token)):
            continue
        start = m.start() + len(token) - len(token.lstrip(_EDGE))
        end = m.end() - (len(token) - len(token.rstrip(_EDGE)))
        while hi <= start and lo <= len(text):
            lo, _, nxt = next(near)
            hi = max(hi, nxt)
        if end - start >= 5 and end <= lo:
            out.append((start, end))
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def _plain(word: str) -> str:
    return _DIGIT.sub("0", word.strip(_EDGE).lower())


def patterns_of(text: str, start: int, end: int) -> list[int]:
    """Lexical patterns of a place: the two words before it, the words before and after it, and the name it is assigned to."""
    before = [_plain(w) for w in text[max(0, start - REACH):start].split()[-2:]]
    after = [_plain(w) for w in text[end:end + REACH].split()[:1]]
    before = ["^"] * (2 - len(before)) + before
    assigned = _ASSIGNED.search(text, max(0, start - REACH), start)
    return [_hash("before", *before), _hash("around", before[-1], *(after or ["$"])), *([_hash("assigned", assigned[1].lower())] if assigned else [])]


def is_secret(text: str, start: int, end: int) -> bool:
    """Whether a span is a quoted run of at least 32 hexadecimal digits."""
    return 0 < start and text[start - 1] in "\"'`" and text[end:end + 1] == text[start - 1] and _SECRET.fullmatch(text, start, end) is not None


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("_key", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ("places", pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
])


def _places(docs: DataFrame) -> DataFrame:
    """Per row: base spans, and every place of a seed or candidate under each of its patterns (kind is null for candidates)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            spans, places = [], []
            for raw in texts:
                text = raw.decode()
                base = base_spans(text)
                spans.append([{"kind": k, "start": s, "end": e} for s, k, e in base])
                everything = [*((s, k, e) for s, k, e in base), *((s, "secret" if is_secret(text, s, e) else None, e) for s, e in candidate_spans(text, base))]
                places.append([
                    {"pattern": p, "instance": _hash(text[s:e].lower()), "kind": k, "start": s, "end": e}
                    for s, k, e in everything for p in patterns_of(text, s, e)
                ])
            yield record({"doc_id": part.column("doc_id"), "_key": part.column("_key"), "base": spans, "places": places}, _ROWS)

    rows = documents(docs)
    return rows.withColumn("_key", F.xxhash64("doc_id", "text")).mapInArrow(
        scan, f"doc_id long, _key long, base {_SPANS}, places array<struct<pattern:long,instance:long,kind:string,start:int,end:int>>")


def score_graph(edges: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind, seeds, score) from edges (pattern, instance, kind, n); kind is null for candidates.

    A pattern's score is the mean score of its edges' instances, short of one edge, and counts every
    occurrence. A candidate's is that of its best pattern: unknown words on one side, or
    further occurrences in unknown places, say nothing against it. Candidates of a pattern with
    ``min_score`` and ``min_seeds`` count as seeds from the next round on, for their best such pattern's kind.
    """
    seeds = edges.where("kind IS NOT NULL").select("instance", "kind").distinct().select("instance", "kind", F.lit(1.0).alias("score"), F.lit(True).alias("base"), F.lit(True).alias("seed"))
    of_pattern = edges.groupBy("pattern").agg(F.sum("n").alias("_all"))
    open_edges = edges.where("kind IS NULL").select("pattern", "instance").join(seeds.select("instance").distinct(), "instance", "left_anti")
    known, patterns = seeds, None
    good = F.when((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds), F.col("score"))
    for k in range(rounds):
        held = edges.select("pattern", "instance", "n", F.col("kind").alias("_own")).join(known, "instance").where(
            "(_own IS NULL AND NOT base) OR (_own = kind AND base)")
        scores = held.groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("_good"), F.count(F.when(F.col("seed"), F.lit(1))).alias("seeds"))
        patterns = settle(scores.join(of_pattern, "pattern").select("pattern", "kind", "seeds", (F.col("_good") / (F.col("_all") + 1)).alias("score")))
        if k + 1 < rounds:
            found = open_edges.join(patterns.where("seeds > 0"), "pattern").groupBy("instance", "kind").agg(F.max("score").alias("score"), F.max(good).alias("good"))
            best = F.max(F.struct(F.coalesce("good", F.lit(0.0)).alias("good"), "kind"))
            kinds = found.groupBy("instance").agg(best.alias("b"), F.collect_list(F.struct("kind", "score")).alias("all"))  # a few kinds each
            # An accepted candidate is certain for its kind and has no other.
            taken = F.col("b.good") > 0
            found = kinds.where(taken).select("instance", "b.kind", F.lit(1.0).alias("score"), F.lit(False).alias("base"), F.lit(True).alias("seed")).unionByName(
                kinds.where(~taken).select("instance", F.explode("all").alias("a")).select("instance", "a.kind", "a.score", F.lit(False).alias("base"), F.lit(False).alias("seed")))
            known = settle(seeds.unionByName(found))
    return patterns


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(doc_id, _key, base, spans) of every row; spans holds the base spans and the discovered ones, by start, then kind.

    ``_key`` is ``xxhash64(doc_id, text)``. Null and empty texts have no spans. Rows may
    repeat. A candidate gets one kind, that of its best pattern. Extra columns are ignored.
    """
    rows = settle(_places(docs))
    places = rows.select("_key", F.explode("places").alias("p")).select("_key", "p.*")
    edges = settle(places.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")))
    patterns = score_graph(edges, rounds, min_score, min_seeds)
    good = patterns.where((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern", F.col("kind").alias("_kind"), "score")
    hits = places.where("kind IS NULL OR kind = 'secret'").select("_key", "pattern", F.col("kind").alias("_shape"), "start", "end").join(good, "pattern").where("_shape IS NULL OR _shape = _kind")
    best = hits.groupBy("_key", "start", "end").agg(F.max(F.struct("score", "_kind")).alias("b"))
    added = best.groupBy("_key").agg(F.collect_list(F.struct(F.col("b._kind").alias("kind"), "start", "end")).alias("added"))
    order = F.array(*[F.lit(k) for k in KINDS])

    def key(s):
        return F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    both = F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))
    ordered = F.transform(F.array_sort(F.transform(both, key)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "_key", "base").join(added, "_key", "left").select("doc_id", "_key", "base", ordered.alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one. ``n_chars``, if there, follows.

    Texts without spans, null ones too, stay as they are. Rows may repeat; other columns, whatever their names, are
    passed through. An empty table gives an empty one.
    """
    found = find_personal_data(docs, **options).where(F.size("spans") > 0).select("_key", "spans").dropDuplicates(["_key"])
    # The whole row travels as one column, so no name of it can clash.
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_key"))
    rows = packed.join(found, "_key", "left")
    hit = rows.where("spans IS NOT NULL").select("_row", F.col("_row.text").cast("string").alias("_text"), "spans")
    schema = T.StructType([hit.schema["_row"], T.StructField("_new", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, s) for t, s in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_new"])

    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    changed = hit.mapInArrow(run, schema).select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
    return changed.unionByName(rows.where("spans IS NULL").select("_row.*"))


def redacted(text: str, spans: list[dict]) -> str:
    out, last = [], 0
    for s in spans:
        if s["start"] >= last:
            out += [text[last:s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])


def _joined(spans: str):
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    found = find_personal_data(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS long) AS n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
