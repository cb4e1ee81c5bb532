import re
from collections import Counter

import numpy as np
import pytest

from cloudgrain.llm import alignment, near_dedup as nd
from cloudgrain.llm.components import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=0.8):
    """doc_id -> class by aligning all pairs of texts."""
    ids = {}
    texts = [(i, np.array([ids.setdefault(x, len(ids)) for x in words(t)])) for i, t in rows if i is not None]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(texts):
        for j, b in texts[:k]:
            if len(a) and len(b) and alignment.similarity_at_least(a, b, least):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in root}


def got(df):
    rows = df.collect()
    return {r.doc_id: r.class_id for r in rows if r.doc_id is not None}, len(rows)


def test_alignment_against_table():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = rng.integers(0, rng.integers(2, 30), rng.integers(0, 40))
        b = a.copy() if rng.random() < 0.5 else rng.integers(0, 20, rng.integers(0, 40))
        for _ in range(rng.integers(0, 8)):
            at = rng.integers(0, len(b) + 1)
            b = np.insert(b, at, 3) if rng.random() < 0.5 else np.delete(b, at) if at < len(b) else b
        want = edits(a.tolist(), b.tolist())
        for limit in {0, 1, want - 1, want, want + 3} - {-1}:
            assert alignment.within(a, b, limit) == (want <= limit)
            if len(a) and len(b):
                assert alignment._walk_wide(a, b, limit) == alignment._walk(a.tolist(), b.tolist(), limit) == (want <= limit)


def test_columns_of_bits_agree_with_single_steps():
    """Many edits: the columns decide as the walk does; bins that words share exclude no pair."""
    rng = np.random.default_rng(21)
    for n, kinds in ((0, 3), (1, 2), (40, 3), (90, 40), (200, 5000)):
        for _ in range(12):
            a = rng.integers(0, kinds, n, dtype=np.uint32) * np.uint32(alignment._BINS)
            b = np.delete(a, rng.integers(0, n, n // 8)) if n else a
            b = np.insert(b, rng.integers(0, len(b) + 1, n // 6), rng.integers(0, kinds, n // 6, dtype=np.uint32))
            for limit in (0, n // 8, n // 5, n // 4, n // 3):
                want = alignment._walk(a.tolist(), b.tolist(), limit)
                assert alignment._columns(a.tolist(), b.tolist(), limit) == want == alignment.within(a, b, limit)


def test_bag_bounds_follow_the_lengths():
    """Texts of unlike lengths may differ less; a longer text that has all words of the shorter one keeps within its bound."""
    bounds = nd.bag_bounds()
    assert bounds[0] == nd.BAG_DIFFER and bounds == sorted(bounds, reverse=True) and bounds[-1] <= 45
    rng = np.random.default_rng(22)
    for step in (0, 5, 10, 15, 20):
        for _ in range(40):
            a = rng.integers(1, 1 << 63, 200, dtype=np.uint64)
            b = a[:200 - 2 * step].copy()
            b[160:] = rng.integers(1, 1 << 63, len(b) - 160, dtype=np.uint64)  # 160 of 200 words in common: a similarity of 0.8
            x = nd.bag_bits(np.concatenate((a, b)), np.array([0, 200]), np.array([200, len(b)])).view(np.uint64)
            assert sum(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555)).bit_count() for v in x[0] ^ x[1]) <= bounds[step]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 50), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {50: 50, 100: 50, 101: 50}


def test_whole_table(docs, texts):
    assert got(nd.near_duplicates(docs))[0] == brute(texts.items())


def test_edge_rows(edge, empty):
    classes, n = got(nd.near_duplicates(edge))
    assert n == edge.count()
    assert classes == brute([(r.doc_id, r.text) for r in edge.collect()])
    assert nd.near_duplicates(empty).count() == 0 and nd.drop_near_duplicates(empty).count() == 0
    kept = nd.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*{c for c in classes.values()}, None])


@pytest.mark.parametrize("leaders", [1, 8])
def test_large_group_and_shared_passage(spark, leaders):
    """Many near copies of one text, and many different texts around one passage."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(100)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, 100, 4):
            w[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    for i in range(120, 180):
        rows.append((i, " ".join([f"q{rng.integers(100000)}" for _ in range(12)] + passage + [f"q{rng.integers(100000)}" for _ in range(12)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(nd.near_duplicates(df, leaders=leaders))[0] == brute(rows)


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (1, a), (2, b), (9, "alone here")], "doc_id long, text string")
    assert got(nd.near_duplicates(df))[0] == {5: 1, 1: 1, 2: 1, 9: 9}


def test_order_matters():
    """Swapped halves share all shingles but few sketches."""
    rng = np.random.default_rng(7)
    s = rng.integers(1, 1 << 63, 200, dtype=np.uint64)
    both = np.concatenate((s, s, np.concatenate((s[100:], s[:100]))))
    k = nd.order_sketches(both, np.array([0, 200, 400]), np.array([200, 200, 200]))
    assert (k[0] == k[1]).all() and 0 < (k[0] == k[2]).mean() < 0.6


def test_links_with_scattered_edits(spark):
    """Pairs of texts just above the link's similarity, words replaced far from each other; short texts and lengths around the borders."""
    rng = np.random.default_rng(11)
    rows = []
    for n in [5, 6, 10, 16, 17, 20, 25, 30, 32, 33, 36, 40, 41, 60, 100, 150, 250, 400] * 8:
        text = [f"v{x}" for x in rng.integers(0, 100_000, n)]
        other = list(text)
        for at in range(0, n // 5 * 5, 5):
            other[at + 2] = f"x{rng.integers(100_000)}"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
        # A longer text: an insertion a quarter from each other.
        longer = [x for i, v in enumerate(text) for x in ([v, f"y{rng.integers(100_000)}"] if i % 4 == 1 and i + 4 <= n else [v])]
        rows += [(len(rows), " ".join(longer))]
    rows += [(len(rows), "one plain text of six words"), (len(rows) + 1, "one plain text of six words more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert sum(i != c for i, c in want.items()) > 200
    assert got(nd.near_duplicates(df))[0] == want


def test_every_round_limits_buckets_before_the_shuffle(spark, monkeypatch):
    """As many leaders as a round may have are chosen in each task first; what a bucket still has open after two rounds meets in one join."""
    asked, real = [], nd._leaders

    def leaders(buckets, n):
        asked.append(n)
        return real(buckets, n)

    monkeypatch.setattr(nd, "_leaders", leaders)
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([f"q{rng.integers(10**6)}" for _ in range(7)] + passage + [f"q{rng.integers(10**6)}" for _ in range(7)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plan = nd._leaders(spark.range(9000).selectExpr("id AS node", "id AS n", "id % 2 AS bucket", "id AS component"), nd.MAX_LEADERS)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan
    monkeypatch.setattr(nd, "MAX_LEADERS", 2)
    asked.clear()
    assert got(nd.near_duplicates(df))[0] == brute(rows)
    assert asked == [1, 2]


def test_unlike_documents_around_a_passage_are_not_aligned(spark, monkeypatch):
    """60 of 300 words in common: aligned pairs grow with the documents, not with their square."""
    aligned, real = [], nd._verified

    def verified(pairs, words, least):
        aligned.append(pairs.count())
        return real(pairs, words, least)

    monkeypatch.setattr(nd, "_verified", verified)
    rng = np.random.default_rng(14)
    passage = [f"p{i}" for i in range(60)]
    for n in (150, 450):
        rows = [(i, " ".join([f"q{x}" for x in rng.integers(0, 10**6, 120)] + passage + [f"q{x}" for x in rng.integers(0, 10**6, 120)])) for i in range(n)]
        rows += [(n + i, rows[i][1].replace("p7", "other")) for i in range(0, n, 10)]
        aligned.clear()
        classes = got(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))[0]
        assert classes == {i: (i - n) if i >= n else i for i, _ in rows}
        assert sum(aligned) <= n


def around(rng, n, passage, own):
    """n texts of one passage between own words; of every twentieth a near copy, and of every thirtieth one whose link is as weak as links may be."""
    rows = [(i, [f"q{x}" for x in rng.integers(0, 10**7, own)] + passage + [f"q{x}" for x in rng.integers(0, 10**7, own)]) for i in range(n)]
    size = 2 * own + len(passage)
    for i in range(0, n, 20):
        rows.append((len(rows), [w if w != passage[3] else "other" for w in rows[i][1]]))
    for i in range(0, n, 30):
        edited = list(rows[i][1])
        for at in rng.permutation([*range(own), *range(size - own, size)])[:size // 5]:
            edited[at] = f"z{rng.integers(10**7)}"
        rows.append((len(rows), edited))
    return [(i, " ".join(w)) for i, w in rows]


def test_texts_that_are_mostly_one_passage_meet_by_their_rare_words(spark, monkeypatch):
    """120 of 180 words in common: bags cannot tell such texts apart, their rarest words can. Every link is found, far fewer pairs are aligned."""
    aligned, real = [], nd._verified

    def verified(pairs, words, least):
        aligned.append(pairs.count())
        return real(pairs, words, least)

    monkeypatch.setattr(nd, "_verified", verified)
    monkeypatch.setattr(nd, "MEET", 8)
    for n in (120, 360):
        rows = around(np.random.default_rng(31), n, [f"p{i}" for i in range(120)], 30)
        aligned.clear()
        classes = got(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))[0]
        assert classes == brute(rows) and sum(i != c for i, c in classes.items()) >= n // 20 + n // 30 - 1
        assert aligned[-1] <= n * n / 20  # some n * n / 2 before; those not alike a leader still meet all others


def test_links_share_a_rare_word():
    """Whatever the counts, two texts with enough words in common share one of their rarest; words of one text alone are left out."""
    rng = np.random.default_rng(32)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 40, n, dtype=np.uint32)
        b = a.copy()
        b[rng.permutation(n)[:int(0.2 * n + 1e-9)]] = rng.integers(0, 1000, int(0.2 * n + 1e-9), dtype=np.uint32)
        x, y = nd._tokens(a.tobytes()), nd._tokens(b.tobytes())
        counts = rng.integers(2, 5, 1 << nd.RARITY_BITS).astype(np.uint32)
        (p, at), (q, _) = nd.rarest(x, counts, 0.8), nd.rarest(y, counts, 0.8)
        assert np.intersect1d(p, q).size and len(p) == int(0.2 * n + 1e-9) + 1 and at.tolist() == list(range(len(p)))
        assert nd.rarest(x, np.ones_like(counts), 0.8)[0].size == 0


@pytest.mark.parametrize("before", [0, 2, 16])
def test_rare_candidates_hold_every_link(spark, monkeypatch, before):
    """Of texts with words in common the pairs hold each with enough of them, however many rarer words a row brings along; the more, the fewer rows repeat."""
    monkeypatch.setattr(nd, "BEFORE", before)
    monkeypatch.setattr(nd, "BAG_DIFFER", nd.BAG_VALUES)
    rng = np.random.default_rng(33)
    texts = [rng.integers(0, 50, int(n), dtype=np.uint32) for n in rng.integers(1, 40, 150)]
    for t in texts[:50]:
        u = t.copy()
        u[rng.permutation(len(t))[:len(t) // 6]] = 99
        texts.append(np.delete(u, 0) if len(u) > 12 else u)
    w = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "node long, words binary")
    crowd = spark.createDataFrame([(i, len(t), i, 0, 0, 0, 0) for i, t in enumerate(texts)], "node long, n int, component long, " + ", ".join(f"{b} long" for b in nd._BAG))
    pairs = {(r.a, r.b) for r in nd._rare_candidates(crowd, w, 0.8).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[i + 1:], i + 1) if sum((Counter(a.tolist()) & Counter(b.tolist())).values()) >= 0.8 * max(len(a), len(b)) - 1e-6}
    assert len(want) > 30 and want <= pairs


def test_bag_bits_estimate_common_words():
    """A link's bits differ within the bound, with room; those of strangers far beyond it."""
    rng = np.random.default_rng(15)
    size, differ, strange = 120, [], []
    for _ in range(60):
        a = rng.integers(1, 1 << 63, size, dtype=np.uint64)
        b, c = a.copy(), a.copy()
        b[rng.permutation(size)[:size // 5]] = rng.integers(1, 1 << 63, size // 5, dtype=np.uint64)
        c[:size * 3 // 4] = rng.integers(1, 1 << 63, size * 3 // 4, dtype=np.uint64)
        bits = nd.bag_bits(np.concatenate((a, b, c)), np.arange(3) * size, np.full(3, size)).view(np.uint64)
        for other, out in ((1, differ), (2, strange)):
            out.append(sum(int((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).bit_count() for x in bits[0] ^ bits[other]))
    assert max(differ) <= nd.BAG_DIFFER and np.mean(differ) == pytest.approx(nd.BAG_VALUES / 4, rel=0.1)
    assert min(strange) > nd.BAG_DIFFER


def test_survivor_of_a_repeated_id(spark):
    """Of several rows of the least doc_id the one whose text sorts first stays, whatever the order of the input."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [(5, b, "x"), (5, a, "y"), (5, a, "x"), (7, b, "z"), (8, None, "n"), (8, None, "m"), (None, b, "k")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, extra string").repartition(3)
        assert sorted(map(tuple, nd.drop_near_duplicates(df).collect()), key=str) == sorted([(5, a, "x"), (8, None, "m"), (None, b, "k")], key=str)


def test_recall_on_a_larger_table(spark):
    """Documents whose id is divisible by 50, against all rows of sf0.1: every link found by alignment is inside a class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    classes = got(nd.near_duplicates(docs))[0]
    ids: dict = {}
    texts = {r.doc_id: np.array([ids.setdefault(x, len(ids)) for x in words(r.text)]) for r in docs.collect()}
    bags = {i: Counter(t.tolist()) for i, t in texts.items()}
    links = missed = 0
    for i in (i for i in texts if i % 50 == 0 and len(texts[i])):
        for j, t in texts.items():
            longest = max(len(t), len(texts[i]))
            # What the bags exclude needs no alignment.
            if j != i and min(len(t), len(texts[i])) >= 0.8 * longest - 1e-6 and sum((bags[i] & bags[j]).values()) >= 0.8 * longest - 1e-6 and alignment.similarity_at_least(texts[i], t, 0.8):
                links += 1
                missed += classes[i] != classes[j]
    assert links > 50 and missed <= 0.01 * links
