import hashlib
from collections import Counter

import numpy as np

from cloudgrain.llm import chunking, fingerprint as fp


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        edited = t[:len(t) - n] + following[:n]
        own, new, other = fp.digests([t.encode(), edited.encode(), following.encode()])
        out[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.to_string(own), fp.to_string(new), fp.containment(own, new), fp.containment(own, other)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_whole_table(docs, texts):
    assert got(fp.compare_edited(docs)) == brute(list(texts.items()))


def test_edge_rows(edge, empty):
    assert got(fp.compare_edited(edge)) == brute([(r.doc_id, r.text) for r in edge.collect()])
    assert fp.compare_edited(empty).count() == 0
    assert fp.fingerprints(edge).count() == edge.count() and fp.fingerprints(empty).count() == 0


def test_likeness_orders_edits_before_strangers(docs):
    rows = fp.compare_edited(docs).where("n_chars > 200").collect()
    assert np.mean([r.near_edited > r.near_next or r.near_next > 0.9 for r in rows]) > 0.97
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_chunks_resist_shifts_and_join_up():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    a, b = chunking.cut_points([text, b"something in front " + text], 16, 48, 192)
    assert a[-1] == len(text) and (np.diff(a, prepend=0) <= 192).all() and (np.diff(a, prepend=0)[:-1] >= 16).all()
    assert len(set(a) & set(b - 19)) > 0.95 * len(a)
    assert (chunking.cut_points([b"", text], 16, 48, 192)[1] == a).all()
    own, same = fp.digests([text, text])
    assert fp.to_string(own) == fp.to_string(same) and (fp.from_string(fp.to_string(own)) == own).all()


def test_no_border_inside_a_character():
    text = "漢字😀é".encode() * 2000
    for cut in chunking.cut_points([text], 256, 1024, 8192, whole_characters=True)[0]:
        text[:cut].decode()


def test_large_ids_beside_a_null(spark):
    """Ids beyond 2**53 keep their order when a row has none."""
    big = 2**53
    rows = [(big + i, f"text number {i} " * (1 + i % 5)) for i in range(400)] + [(None, "no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(fp.compare_edited(df)) == brute(rows)
