import hashlib
import re
from collections import Counter

import numpy as np

from cloudgrain.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(d):
    return (sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0


def brute_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and checksum(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda x: (x[0], list(RULES).index(x[1])))


def test_base_rules_on_texts(texts):
    for t in texts.values():
        assert pii.base_spans(t) == brute_spans(t)


def test_base_rules_on_noise():
    rng = np.random.default_rng(8)
    found = Counter()
    for alphabet in ("a@.b-1", "0123.456 ", "+1 ()-.9", "49 -1", "é@a.b+1 2"):
        for _ in range(1500):
            t = "".join(rng.choice(list(alphabet), rng.integers(0, 60)))
            assert pii.base_spans(t) == brute_spans(t), t
            found.update(k for _, k, _ in pii.base_spans(t))
    assert set(found) == set(RULES)
    assert pii.base_spans("1" * 6000 + ".1.1.1") == [] and pii.base_spans("0" * 5000 + "1.2.3.4")[0][1] == "ip"
    assert pii.base_spans("a" * 200_000 + "@" * 200_000) == []


def rows_of(df):
    return {r.doc_id: (r.base, r.spans) for r in df.collect()}


def test_query_columns(spark, sf, texts):
    for r in pii.op8_personal_data(spark, sf).collect():
        want = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in RULES]
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined


def test_context_finds_unseen_identifiers(spark):
    """Account numbers in the contexts of cards, which no base rule accepts; ordinary numbers elsewhere."""
    seeds = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "6011000000000004"]
    rows = [(i, f"text {i} pay with card number {seeds[i % 4]} today or {1000 + i}x years ago") for i in range(200)]
    rows += [(1000 + i, f"some story {i} then card number A77-{i}-B today and version v{i}.{i}5 later") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rows_of(pii.find_personal_data(df, min_seeds=4))
    text = dict(rows)
    for i in range(1000, 1005):
        assert [(s.kind, text[i][s.start:s.end]) for s in found[i][1]] == [("card", f"A77-{i - 1000}-B")]
    for i in range(200):
        assert set(found[i][0]) <= set(found[i][1])
    assert not [s for i, (_, spans) in found.items() for s in spans if "years" in text[i][s.end:s.end + 6]]


def _word(i):
    return "".join("abcdefghij"[int(d)] for d in f"{i:04d}")


def test_following_words_may_differ_and_finds_are_seeds(spark):
    """A known lead-in is enough, whatever follows; what it finds bears out a lead-in that no base seed has."""
    seeds = [f"user{_word(i)}@example.com" for i in range(200)]
    rows = [(i, f"{_word(i)} write to address {s} {_word(3000 + i)}") for i, s in enumerate(seeds)]
    rows += [(1100 + i, f"{_word(i)} write to address KX-{i}-77 {_word(4000 + i)}") for i in range(12)]
    rows += [(1200 + i, f"{_word(i)} filed beneath token KX-{i}-77 {_word(5000 + i)}") for i in range(12)]
    rows += [(1300, "whoever filed beneath token QQ-5-31 left"), (1301, "in the year 2021x nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text, found = dict(rows), rows_of(pii.find_personal_data(df))
    named = {i: [(s.kind, text[i][s.start:s.end]) for s in spans] for i, (_, spans) in found.items()}
    assert all(named[1100 + i] == named[1200 + i] == [("email", f"KX-{i}-77")] for i in range(12))
    assert named[1300] == [("email", "QQ-5-31")] and named[1301] == []
    # Without a further round the second lead-in is unknown.
    once = rows_of(pii.find_personal_data(df, rounds=1, min_score=0.5))
    assert len(once[1100][1]) == 1 and not once[1300][1]


def test_edge_rows(edge, empty):
    assert pii.find_personal_data(edge).count() == edge.count()
    assert pii.find_personal_data(empty).count() == 0
    out = pii.redact(edge)
    assert out.columns == edge.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, edge.collect()))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail me.1@a-b.example.com or +1 (640) 555-0953 now", 99, None), (2, None, None, "x"), (3, "clean", 5, "x")], "doc_id long, text string, n_chars long, kind string")
    got = {r.doc_id: (r.text, r.n_chars, r.kind) for r in pii.redact(df).collect()}
    assert got == {1: ("é mail [EMAIL] or [PHONE] now", 29, None), 2: (None, None, "x"), 3: ("clean", 5, "x")}


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["spans", "_key", "_row", "_new", "_text", "base", "places"]
    df = spark.createDataFrame([(1, "mail me.1@a-b.example.com now", *names), (2, "clean", *names[::-1]), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = sorted(map(tuple, pii.redact(df).collect()), key=str)
    assert pii.redact(df).columns == df.columns
    assert got == sorted([(1, "mail [EMAIL] now", *names), (2, "clean", *names[::-1]), (None, None, *names)], key=str)


def test_assigned_secrets_and_values_of_other_shapes(spark):
    """Quoted digests after one name bear out that name; what else it is given is found too, digests elsewhere are left alone."""
    digest = lambda i: f"{i * 2654435761 % 2**32:08x}" * 5
    rows = [(i, f'{_word(i)} token = "{digest(i)}" {_word(2000 + i)}') for i in range(40)]
    rows += [(100, 'then TOKEN = "Zx91-plain-77" follows'), (101, f'a digest "{digest(7)}" by itself'), (102, f'sum: {digest(8)} unquoted'), (103, "token = none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text, found = dict(rows), rows_of(pii.find_personal_data(df))
    named = {i: [(s.kind, text[i][s.start:s.end]) for s in spans] for i, (_, spans) in found.items()}
    assert all(named[i] == [("secret", digest(i))] for i in range(40))
    assert named[100] == [("secret", "Zx91-plain-77")] and named[102] == named[103] == []
    assert all(not base for base, _ in found.values())
    assert "[SECRET]" in {r.doc_id: r.text for r in pii.redact(df).collect()}[3]
    # Fewer than MIN_SEEDS different ones bear out nothing.
    assert not any(s for _, s in rows_of(pii.find_personal_data(df.where("doc_id < 4"))).values())


def test_spans_added_on_the_supplied_table(spark):
    """Every planted assignment of sf0.1 is found, and nothing in texts without one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    added = {i: [texts[i][s.start:s.end] for s in spans if s.kind == "secret"] for i, (_, spans) in rows_of(pii.find_personal_data(docs)).items()}
    want = {i: re.findall(r'(?i)token = "([0-9a-f]{40})"', t) for i, t in texts.items()}
    assert sum(map(len, want.values())) > 100 and added == want
