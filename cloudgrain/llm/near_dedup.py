"""Near-duplicate documents by order MinHash and banded alignment.

Documents are sequences of two-word shingles of their normalised words, each labelled with its
occurrence number; short documents are sequences of single words. A sketch takes the ``KEEP`` least labelled shingles under a hash function and
joins them in the order in which they stand in the text, so sharing a sketch takes the same
shingles in the same order: its probability follows edit similarity, which plain MinHash
cannot see. Documents that share one of ``SKETCHES`` sketches are candidates; a banded alignment of their
words decides: a link is an edit similarity of ``SIMILARITY`` or more.

Equal word sequences form one node first. Within a bucket no pairs of all members are made: one
member leads and meets all others, and what they link is joined to components. The first round takes a few bands only: they join
most copies. A second one takes more leaders (those whom the bucket's main component has not taken in) and, of buckets of up to ``MEET``
members, all bands, for pairs of different components alone. So a group of thousands of copies costs a few comparisons per member.
What buckets then still hold of different components meets in one join, but for the crowd: members of larger buckets whose bag was
alike a leader's, mostly unlike documents around one long passage. Two of the crowd meet where they share one of their rarest words (``_rare_candidates``): a text of n words can only have a
link to texts that share one of the rarest ``n / 5 + 1`` of its labelled words, so this loses no link, and what all of them share brings none of them together.
No pair of a bucket is left uncompared unless both are known to belong together or their words exclude a link.

A linked pair has at least two thirds of its labelled words in common (Jaccard). Every node carries ``BAG_VALUES`` two-bit MinHash
values of them, and only pairs meet of which at most ``BAG_DIFFER`` values differ: unlike documents around
one passage are compared by 32 bytes inside the join and never aligned. Texts are read again for the pairs that are left.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, settle
from .alignment import similarity_at_least
from .components import components
from .filters import id_filter, passes
from .text import BATCH_ROWS, FOLDED, Words, blocks, documents, give_back, gram_hashes, inside_text, mix, read, record, run_hashes

SHINGLE = 2
#: Texts of up to ``WORDS_TO`` words are sketched by words, those from ``GRAMS_FROM`` on by shingles. Texts
#: whose lengths differ by less than half thus have one of the two in common.
WORDS_TO, GRAMS_FROM = 32, 17
SIMILARITY = 0.8
#: An edit of a word breaks two shingles, so an edit similarity s leaves a share k = s * s of the shingles and both
#: orders of them a Jaccard similarity j = k / (2 - k). ``SKETCHES`` of ``KEEP`` all differ with (1 - j**2)**64: 1e-7 at s = 0.8.
#: Replaced words that never are neighbours leave k = 2 * s - 1: 2e-6. Short texts: j = s / (2 - s), 1e-14 or less.
SKETCHES, KEEP = 64, 2
#: A value differs with 3/4 * (1 - J), at most 1/4 for a link: more than 59 of 128 do so with 1e-7. At J = 0.25 one pair in 100 is left, at 0.11 one in a million.
BAG_VALUES, BAG_DIFFER = 128, 59
BAG_MISS = 1e-7  # of the bound for texts of unlike lengths, see ``bag_bounds``
EARLY = 8  # bands of the first round
MEET = 64  # members of a bucket up to which the second round takes all bands; of larger ones the crowd is picked
RARITY_BITS = 20  # of the places in which words are counted; places that words share make them seem more frequent, see ``_rare_candidates``
BEFORE = 16  # rarer words that a rare word brings along, so that a pair with many in common comes out once or few times
LEADERS, GROWTH = 1, 8
MAX_LEADERS = 1000  # of a round: Spark's spark.sql.optimizer.windowGroupLimitThreshold, see ``_leaders``
FILTER_BITS = 27  # of the filters that pick shared buckets and the texts to read again; a full one passes more, never less
_SEEDS = np.random.default_rng(20240603).integers(0, 1 << 63, (2, SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAG_SEEDS = np.random.default_rng(20240604).integers(0, 1 << 31, BAG_VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACE_BITS = 24
_BAG = [f"bag{i}" for i in range(BAG_VALUES // 32)]

_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()),
    ("sketches", pa.list_(pa.int64())), *((b, pa.int64()) for b in _BAG),
])
_WORDS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.binary())])


def labelled_by_occurrence(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values mixed with how many equal ones stand before them in their text."""
    by_value = np.lexsort((values, owner))
    ordered = values[by_value]
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (np.diff(owner) != 0)
    start = np.flatnonzero(new)
    occurrence = np.empty(len(ordered), np.uint64)
    occurrence[by_value] = (np.arange(len(ordered)) - np.repeat(start, np.diff(np.append(start, len(ordered))))).astype(np.uint64)
    return mix(values + mix(occurrence))


def bag_bits(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(texts, BAG_VALUES / 32) two-bit MinHash values, packed, of the labelled words of runs of at least one word."""
    small = (labelled_by_occurrence(words, np.repeat(np.arange(len(first)), lengths)) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first), BAG_VALUES // 32), np.uint64)
    for j in range(BAG_VALUES):
        least = np.minimum.reduceat(small * _BAG_SEEDS[j], first)
        value = (least * np.uint32(0x9E3779B1)) >> np.uint32(30)
        out[:, j // 32] |= value.astype(np.uint64) << np.uint64(2 * (j % 32))
    return out.view(np.int64)


def bag_bounds(steps: int = 20) -> list[int]:
    """How many of the bag's values may differ for a link, by hundredths of the share that the shorter text lacks of the longer one's length.

    A link of lengths in the ratio r has ``SIMILARITY`` of the longer text's words in common, a Jaccard similarity of
    ``SIMILARITY / (r + 1 - SIMILARITY)`` or more: the more the lengths differ, the less the bags may.
    """
    bounds = []
    for step in range(steps + 1):
        p = 0.75 * max(0.0, 1 - SIMILARITY / (1 - step / 100 + 1 - SIMILARITY))
        more = np.cumsum([math.comb(BAG_VALUES, k) * p**k * (1 - p) ** (BAG_VALUES - k) for k in range(BAG_VALUES, 0, -1)])  # P(k or more differ)
        bounds.append(min(BAG_DIFFER, BAG_VALUES - int((more <= BAG_MISS).sum())))
    return bounds


def order_sketches(shingles: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) sketches of runs of shingles, all of at least one shingle."""
    owner = np.repeat(np.arange(len(first)), lengths)
    labelled = labelled_by_occurrence(shingles, owner)
    # The low bits of a value say where in its text it stands, so a least value brings its place along.
    low = np.uint64((1 << max(_PLACE_BITS, int(lengths.max()).bit_length())) - 1)
    place = (np.arange(len(labelled)) - np.repeat(first, lengths)).astype(np.uint64)
    padded = np.append(labelled, np.uint64(0))
    value = np.empty(len(labelled), np.uint64)
    out = np.empty((len(first), SKETCHES), np.uint64)
    for j in range(SKETCHES):
        np.multiply(labelled ^ _SEEDS[0, j], _SEEDS[1, j], out=value)
        np.bitwise_and(value, ~low, out=value)
        np.bitwise_or(value, place, out=value)
        least = np.empty((len(first), KEEP), np.int64)
        for r in range(KEEP):
            found = np.minimum.reduceat(value, first)
            at = first + (found & low).astype(np.int64)
            some = found != _LAST
            least[:, r] = np.where(some, at, len(labelled))
            value[at[some]] = _LAST
        least.sort(axis=1)
        padded[-1] = np.uint64(j + 1)
        joined = np.zeros(len(first), np.uint64)
        for r in range(KEEP):
            joined = mix(joined * np.uint64(3) + padded[least[:, r]])
        out[:, j] = joined
    return out


def _names(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the word sequence of each text; 0 for texts without words."""
    n = np.diff(w.offsets)
    some = np.flatnonzero(n)
    name = np.zeros((2, len(n)), np.int64)
    name[0, some] = run_hashes(w.hash, w.offsets[some], n[some]).astype(np.int64)
    name[1, some] = run_hashes(mix(w.hash ^ np.uint64(77)), w.offsets[some], n[some]).astype(np.int64)
    return name[0], name[1]


def _signatures(rows: DataFrame) -> DataFrame:
    """Names, bag bits and, under ``sketches``, the buckets of every text; those of a band have its number mixed in."""
    bands = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            w = Words(texts, FOLDED)
            n = np.diff(w.offsets)
            h1, h2 = _names(w)
            bag = np.zeros((len(n), len(_BAG)), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                bag[some] = bag_bits(w.hash, w.offsets[some], n[some])
            sketches, owner = [], []
            for size, which in ((1, (n > 0) & (n <= WORDS_TO)), (SHINGLE, n >= GRAMS_FROM)):
                if not which.any():
                    continue
                some = np.flatnonzero(which)
                grams = gram_hashes(w.hash, size)
                ok = inside_text(w, size) & which[w.text_of()[:len(grams)]]
                lengths = n[some] - size + 1
                sketches.append(mix(order_sketches(grams[ok], np.cumsum(lengths) - lengths, lengths) ^ bands).view(np.int64).ravel())
                owner.append(np.repeat(some, SKETCHES))
            owner = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)
            # Stable: a text's sketches keep their order, which names their bands.
            values = np.concatenate([*sketches, np.zeros(0, np.int64)]).astype(np.int64)[np.argsort(owner, kind="stable")]
            count = np.bincount(owner, minlength=len(n))
            yield record({
                "doc_id": part.column("doc_id"), "h1": h1, "h2": h2, "n": n.astype(np.int32),
                "sketches": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(count))).astype(np.int32), values),
                **{b: bag[:, i].copy() for i, b in enumerate(_BAG)},
            }, _SIGNED)
        give_back()

    return rows.mapInArrow(emit, "doc_id long, h1 long, h2 long, n int, sketches array<long>, " + ", ".join(f"{b} long" for b in _BAG))


def _shared_buckets(nodes: DataFrame, filter_bits: int) -> DataFrame:
    """(bucket, early, node, n, bag...) of the buckets that at least two nodes share.

    A bit map of them passes the nodes' buckets where they lie, so only those few are sent.
    """
    pieces = nodes.select("node", F.explode("sketches").alias("bucket"))
    shared = settle(pieces.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket"))
    some = nodes.sparkSession.sparkContext.broadcast(id_filter(shared, filter_bits))
    schema = pa.schema([("bucket", pa.int64()), ("early", pa.bool_()), ("node", pa.int64()), ("n", pa.int32()), *((b, pa.int64()) for b in _BAG)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketches")
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            band = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % SKETCHES
            keep = passes(some.value, flat, filter_bits)
            row = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(band[keep] < EARLY), *[batch.column(c).take(row) for c in ("node", "n", *_BAG)]], schema=schema)
        give_back()

    passed = nodes.select("node", "n", *_BAG, "sketches").mapInArrow(emit, "bucket long, early boolean, node long, n int, " + ", ".join(f"{b} long" for b in _BAG))
    buckets = settle(passed.join(shared, "bucket", "left_semi"))
    some.destroy()
    give_back()  # of the driver: every bit map passes through it
    discard(shared)
    return buckets


def _words_of(rows: DataFrame, wanted: DataFrame, filter_bits: int) -> DataFrame:
    """(node, words) of wanted nodes (doc, h1, h2, node), written: texts are read again and passed where they lie, so only wanted ones are sent, once."""
    shared = rows.sparkSession.sparkContext.broadcast(id_filter(wanted.select("doc").distinct(), filter_bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for part, texts in blocks(iter([batch.filter(pa.array(passes(shared.value, ids, filter_bits)))])):
                w = Words(texts, FOLDED)
                h1, h2 = _names(w)
                small = memoryview((w.hash >> np.uint64(32)).astype(np.uint32)).cast("B")
                yield record({
                    "doc_id": part.column("doc_id"), "h1": h1, "h2": h2,
                    "words": [bytes(small[4 * a:4 * b]) for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist())],
                }, _WORDS)
        give_back()

    some = rows.where("doc_id IS NOT NULL").mapInArrow(emit, "doc_id long, h1 long, h2 long, words binary")
    # Rows that repeat a document are dropped where the join has brought them together.
    exact = some.join(wanted.withColumnRenamed("doc", "doc_id"), ["doc_id", "h1", "h2"])
    found = settle(exact.dropDuplicates(["doc_id", "h1", "h2"]).select("node", "words"))
    shared.destroy()
    give_back()
    return found


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose aligned words are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity_at_least(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist())]
            yield record({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}, schema)
        give_back()

    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(align, "a long, b long")


def _tokens(words: bytes) -> np.ndarray:
    """The labelled words of a text, all different."""
    values = np.frombuffer(words, np.uint32).astype(np.uint64)
    return labelled_by_occurrence(values, np.zeros(len(values), np.int64))


def _place(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _word_counts(words: DataFrame) -> np.ndarray:
    """How many texts have a labelled word, by place: 2**RARITY_BITS counts, whatever the number of texts."""
    schema = pa.schema([("place", pa.int32()), ("texts", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for text in batch.column("words"):
                np.add.at(counts, _place(_tokens(text.as_py())), 1)
        some = np.flatnonzero(counts)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo:lo + (1 << 16)]
            yield record({"place": part, "texts": counts[part]}, schema)
        give_back()

    found = words.select("words").mapInArrow(emit, "place int, texts long").groupBy("place").agg(F.sum("texts").alias("texts")).toArrow()
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    counts[found.column("place").to_numpy()] = found.column("texts").to_numpy()
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32)


def rarest(tokens: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest tokens of a text, of which a link shares one at least, and their ranks in it; tokens of one text alone are left out.

    A link of texts of up to L words has ``L - edits`` of them in common, with at most ``(1 - least) * L`` edits. Take all texts' tokens in one
    order, whichever: were none of a text's first ``edits + 1`` common to such a pair's first ones, too few would be.
    """
    order = np.lexsort((tokens, counts[_place(tokens)]))[:int((1 - least) * len(tokens) + 1e-9) + 1]
    rank = np.flatnonzero(counts[_place(tokens[order])] > 1)
    return tokens[order[rank]], rank


def _rare_candidates(crowd: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``crowd`` (node, n, component, bag...) that share a rare word and whose lengths, bags and rarer words allow a link; few come out more than once.

    What stands before the first common word of a pair is in one text alone, so what follows must suffice. A pair is passed over at a word if one
    of the ``BEFORE`` rarer ones just before it is common too: it came out there, or before. These are told apart by 32 bits, which loses a link with less than 10^-7.
    """
    mine = settle(crowd.join(words, "node"))
    shared = crowd.sparkSession.sparkContext.broadcast(_word_counts(mine))
    plain = ("node", "n", "component", *_BAG)
    schema = pa.schema([("token", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.int32())), *((c, pa.int32() if c == "n" else pa.int64()) for c in plain)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("words")):
                tokens, rank = rarest(_tokens(text.as_py()), shared.value, similarity)
                short, tokens = (tokens >> np.uint64(32)).astype(np.uint32).view(np.int32), tokens.view(np.int64)
                for lo in range(0, len(tokens), BATCH_ROWS):
                    k = np.arange(lo, min(lo + BATCH_ROWS, len(tokens)))
                    sizes = np.minimum(k, BEFORE)
                    ends = np.cumsum(sizes)
                    inner = np.arange(int(ends[-1])) + np.repeat(k - ends, sizes)
                    yield record({
                        "token": tokens[k], "at": rank[k].astype(np.int32),
                        "before": pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), short[inner]),
                        **{c: pa.repeat(batch.column(c)[i], len(k)) for c in plain},
                    }, schema)
        give_back()

    rare = settle(mine.select(*plain, "words").mapInArrow(emit, "token long, at int, before array<int>, node long, n int, component long, " + ", ".join(f"{b} long" for b in _BAG)))
    shared.destroy()
    give_back()
    discard(mine)
    other = rare.select("token", F.col("at").alias("_at"), F.col("before").alias("_before"), F.col("node").alias("_lead"), F.col("n").alias("_n"), F.col("component").alias("_own"), *[F.col(b).alias(f"_{b}") for b in _BAG])
    room = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= F.greatest("n", "_n") * similarity - 1e-6
    close = (F.col("_lead") < F.col("node")) & room & _close(similarity) & ~F.arrays_overlap("before", "_before")
    met = rare.withColumnRenamed("token", "_token").join(other, (F.col("_token") == F.col("token")) & close)
    pairs = settle(met.select(F.col("_lead").alias("a"), F.col("node").alias("b")).distinct())
    discard(rare)
    return pairs


def _leaders(buckets: DataFrame, leaders: int) -> DataFrame:
    """The first ``leaders`` members of each bucket: members of the latest components, those that its main group has not taken in.

    Up to ``MAX_LEADERS`` Spark applies the limit before the shuffle too, so a bucket sends a few rows per task.
    """
    order = W.partitionBy("bucket").orderBy(F.desc("component"), "node", "n")
    return _as_leaders(buckets.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= leaders))


def _open(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold members of different components, with their number as ``size``."""
    some = buckets.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("bucket", "size")
    return buckets.drop("size").join(some, "bucket")


def _as_leaders(rows: DataFrame) -> DataFrame:
    own = [F.col(b).alias(f"_{b}") for b in (*_BAG, "crowd") if b in rows.columns]
    return rows.select("bucket", F.col("node").alias("_lead"), F.col("n").alias("_n"), F.col("component").alias("_own"), *own)


def _differing(bag: str) -> Column:
    """How many of the 32 two-bit values of two words of bits differ."""
    x = F.col(bag).bitwiseXOR(F.col(f"_{bag}"))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _close(similarity: float) -> Column:
    """Whether a member and a leader are of different components and their lengths and bags allow a link."""
    differ = reduce(operator.add, map(_differing, _BAG))
    close = (F.col("component") != F.col("_own")) & (F.least("n", "_n") >= F.greatest("n", "_n") * similarity - 1e-6)
    # The bounds on the bags hold for a similarity of 0.8; a lower one allows more words to differ.
    if similarity >= SIMILARITY:
        bounds = bag_bounds()
        lacking = F.floor((F.lit(1.0) - F.least("n", "_n") / F.greatest("n", "_n")) * 100 - 1e-6).cast("int")
        close = close & (differ <= F.get(F.array(*map(F.lit, bounds)), F.least(F.greatest(lacking, F.lit(0)), F.lit(len(bounds) - 1))))
    return close


def _candidates(buckets: DataFrame, lead: DataFrame, similarity: float, each_once: bool = False) -> DataFrame:
    """Distinct pairs (a, b) of leaders and members of other components whose lengths and bags allow a link; ``each_once``: all members lead, two of the crowd do not meet."""
    close = _close(similarity)
    if each_once:
        close = (F.col("_lead") < F.col("node")) & ~(F.col("crowd") & F.col("_crowd")) & close
    met = buckets.withColumnRenamed("bucket", "_bucket").join(lead, (F.col("_bucket") == F.col("bucket")) & close)
    return met.select(F.least("_lead", "node").alias("a"), F.greatest("_lead", "node").alias("b")).distinct()


def _classes(docs: DataFrame, similarity: float, leaders: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of documents that have words, one row each, and all rows' ids."""
    rows = documents(docs)
    signed = settle(_signatures(rows))
    worded = signed.where("doc_id IS NOT NULL AND n > 0")
    once = [F.first(c).alias(c) for c in ("n", "sketches", *_BAG)]
    nodes = settle(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), *once).withColumn("node", F.monotonically_increasing_id()))
    members = settle(worded.select("doc_id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node"))
    discard(signed)
    buckets = _shared_buckets(nodes, filter_bits)
    named = settle(nodes.select("doc", "h1", "h2", "node"))
    discard(nodes)
    # Nodes of one doc_id with several texts are one document from the start.
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_hi")).where("a < _hi")
    links = settle(members.join(several, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct())
    words, read_now, component = None, [], None

    def know(some: DataFrame) -> DataFrame:
        """Words of all nodes asked for so far."""
        nonlocal words
        fresh = some if words is None else some.join(words.select("node"), "node", "left_anti")
        wanted = settle(named.join(fresh, "node"))
        if words is None or not wanted.isEmpty():
            read_now.append(_words_of(rows, wanted, filter_bits))
            words = read_now[0] if words is None else words.unionByName(read_now[-1])
        discard(wanted)
        return words

    buckets = buckets.withColumn("component", F.col("node"))
    for turn in ("early", "leaders", "rest"):
        some = buckets.where({"early": "early", "leaders": f"early OR size <= {MEET}", "rest": "true"}[turn])
        lead = _as_leaders(some) if turn == "rest" else _leaders(some, leaders if turn == "early" else min(leaders * GROWTH, MAX_LEADERS))
        pairs = settle(_candidates(some, lead, similarity, turn == "rest"))
        if turn == "rest":
            crowd = settle(buckets.where("crowd").select("node", "n", "component", *_BAG).distinct())
            if not crowd.isEmpty():
                few, rare = pairs, _rare_candidates(crowd, know(crowd.select("node")), similarity)
                pairs = settle(few.union(rare).distinct())
                discard(few)
                discard(rare)
            discard(crowd)
        alike = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        know(alike)
        added = settle(links.union(_verified(pairs, words, similarity)))
        discard(pairs)
        discard(links)
        # The components so far stand for all links that made them.
        component = settle(components(added))
        discard(added)
        links = component.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        if turn == "rest":
            discard(alike)
            break
        rest = buckets.drop("component", "size").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        left = settle(_open(rest))
        if turn == "leaders":
            # Those that led have met all others. Only small open buckets are looked through for them, in large ones they are few.
            led = lead.select("bucket", F.col("_lead").alias("node"))
            small = _open(left.where(f"size <= {MEET}").join(led, ["bucket", "node"], "left_anti")).withColumn("crowd", F.lit(False))
            large = left.where(f"size > {MEET}").join(alike.withColumn("crowd", F.lit(True)), "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
            every, left = left, settle(small.unionByName(large))
            discard(every)
        discard(alike)
        discard(buckets)
        buckets = left
        if buckets.isEmpty():
            break
    for table in (*read_now, named, buckets):
        discard(table)
    classed = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return classed.join(least, "component").groupBy("doc_id").agg(F.min("class_id").alias("class_id")), rows


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, leaders: int = LEADERS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least doc_id among those linked, directly or in steps.

    Texts without words and rows without doc_id stand alone (class_id is their doc_id). Rows may
    repeat; rows of one doc_id with several texts count as one document, linked by any of them. Extra columns are ignored.
    """
    classes, rows = _classes(docs, similarity, leaders, filter_bits)
    return rows.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, of its least doc_id; rows without doc_id stay. Keeps the columns of ``docs``.

    Of several rows of that doc_id the one stays whose text sorts first (null before all), then the one whose whole row does as JSON.
    """
    classes = near_duplicates(docs, similarity)
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    row = F.struct(*[F.col(c) for c in docs.columns])
    first = kept.groupBy(F.col("doc_id").alias("_doc")).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("_row"))
    return first.select("_row.*").unionByName(docs.where("doc_id IS NULL"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
