import re
from collections import Counter

import numpy as np

from cloudgrain.llm import fm_index, substring_dedup as sd


def brute(rows):
    """(doc_id, n_words, n_removed, kept) of every row."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_whole_table(docs, texts):
    assert got(sd.remove_repeats(docs)) == brute(texts.items())


def test_edge_rows(edge, empty):
    assert got(sd.remove_repeats(edge)) == brute([(r.doc_id, r.text) for r in edge.collect()])
    assert sd.remove_repeats(empty).count() == 0


def test_small_filters_shards_and_hot_lines(spark, monkeypatch):
    """A common line in many surroundings, with every limit so low that it counts."""
    rng = np.random.default_rng(1)
    line = [f"line{i}" for i in range(20)]
    rows = []
    for i in range(300):
        own = [f"w{rng.integers(40)}" for _ in range(rng.integers(0, 40))]
        at = rng.integers(0, len(own) + 1)
        rows.append((i, " ".join(own[:at] + line[rng.integers(0, 4):] + own[at:])))
    rows += [(1000 + i, "again " * 40) for i in range(3)]
    monkeypatch.setattr(sd, "HOT_RUNS", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(sd.remove_repeats(df, filter_bits=17, shard_words=64)) == brute(rows)


def test_matching_statistics_against_search():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 30)
    values = rng.integers(1, 5, sizes.sum()).astype(np.uint64) * np.uint64(977)
    owners = rng.integers(0, 9, 30)
    index = fm_index.FMIndex(values, sizes, owners, 13)
    query_sizes = rng.integers(1, 50, 20)
    query = rng.integers(1, 7, query_sizes.sum()).astype(np.uint64) * np.uint64(977)
    length, row = index.matching_statistics(query, query_sizes)
    parts = np.split(values, np.cumsum(sizes)[:-1])
    at = 0
    for q in query_sizes:
        own = query[at:at + q]
        for i in range(q):
            best, owner = 0, None
            for part, o in zip(parts, owners):
                for j in range(len(part)):
                    n = 0
                    while n < 13 and i + n < q and j + n < len(part) and own[i + n] == part[j + n]:
                        n += 1
                    if n > best:
                        best, owner = n, o
                    elif n == best and n:
                        owner = min(owner, o)
            assert length[at + i] == best
            if best == 13:
                assert index.least_owner[row[at + i]] == owner
        at += q


def test_wavelet_rank():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletTree(s.copy(), 37)
    c, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert tree.rank(c[np.isin(c, s)], at[np.isin(c, s)]).tolist() == [int((s[:j] == x).sum()) for x, j in zip(c, at) if x in s]
