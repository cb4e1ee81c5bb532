import re
from collections import Counter

from cloudgrain.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    windows = []
    for item, t in items:
        w = words(t)
        if w and item is not None:
            n = min(10, len(w))
            windows += [(tuple(w[i:i + n]), str(item)) for i in range(len(w) - n + 1)]
    out = Counter()
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for g, item in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names.add(item)
        out[i, len(w), len(hit), tuple(sorted(names))] += 1
    return out


ITEMS = [(10, "b c D e, f g h i j k l"), (9, "漢字 😀"), (2, "one"), (3, None), (4, " ... "), (10, "again the"), (None, "a b"), (77, "the the the the the the the the the the")]


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in df.collect())


def test_edge_rows_by_either_way(spark, edge, empty):
    bench = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    want = brute([(r.doc_id, r.text) for r in edge.collect()], ITEMS)
    assert got(dc.contamination(edge, bench)) == want
    assert got(dc.contamination(edge, bench, max_broadcast_windows=0)) == want
    assert got(dc.contamination(edge, bench, max_broadcast_windows=2)) == want
    assert dc.contamination(empty, bench).count() == 0
    assert not any(n for _, _, n, _ in got(dc.contamination(edge, bench.where("false"))))


def test_removal(spark):
    bench = spark.createDataFrame([(1, "p q r s t u v w x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é before P q, r s t u v w x y Z! after and more words to keep here so that it stays", 1, "a"), (2, "p q r s t u v w x y", 2, "b"), (3, "clean", 5, "c"), (None, None, None, None)], "doc_id long, text string, n_chars long, _clean string")
    rows = {r.doc_id: (r.text, r.n_chars, r._clean) for r in dc.remove_contamination(docs, bench).collect()}
    text = "é before ! after and more words to keep here so that it stays"
    assert rows == {1: (text, len(text), "a"), 3: ("clean", 5, "c"), None: (None, None, None)}


def test_a_benchmark_of_many_bytes_is_not_broadcast(spark, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    key = lambda r: (r.doc_id, r.n_hit, tuple(r["items"]), r.clean_text)
    near = sorted(map(key, dc.contamination(docs, bench).collect()))
    monkeypatch.setattr(dc, "MAX_BROADCAST_BYTES", 10)
    far = dc.contamination(docs, bench)
    assert "Join" in far._jdf.queryExecution().executedPlan().toString() and sorted(map(key, far.collect())) == near
