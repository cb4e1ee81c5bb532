import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import pytest

from cloudgrain.llm import dawg, repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(turns):
    """(cost, audit, repaired turns) by search over all edits; turns are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if (at, roles[-2:], len(roles) > 2) in done:
            continue
        done.add((at, roles[-2:], len(roles) > 2))
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        steps = [(3, "I", "user", ""), (3, "I", "assistant", "")]
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                steps += [(late, "K", role, text), (3 + late, "R", "user", text), (3 + late, "R", "assistant", text)]
        for more, letter, role, text in steps:
            now = roles + (role[:1] or "x")
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, audit + letter, at + (letter != "I"), now, (*out, f"{role}:{text}")))


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faulty.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        at = [t for t, *_ in turns if t is not None]
        cost, audit, lines = cheapest(faulty)
        faults = [f for *_, f in faulty]
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, *_), (b, *_) in itertools.pairwise(faulty))
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def reported(spark, monkeypatch, rows):
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, pos long, symbol string, block string").repartition(3)
    monkeypatch.setattr(repair, "read", lambda *_: df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in repair.op12_conversation_repair(spark, "").collect()), key=str)


def small_table():
    texts, roles = ["Yes.", "no end", "", " \t", "Why? ", "é\n!\x0b", None, "Yes."], ["user", "assistant", "system", "tool", None, ""]
    rows = [(c, t, roles[(c * 7 + t * t + c // 5) % 6 if (c + t) % 3 else t % 2], texts[(c * 3 + t * 5) % 8]) for c in range(60) for t in range(c % 7)]
    rows += [(100, None, "user", "late."), (100, None, "system", "x."), (101, None, "assistant", "a."), (None, 3, "user", "u."), (None, None, "assistant", None), (102, 5, "user", "same."), (102, 5, "user", "same."), (102, -3, "", "word " * 4000)]
    return rows


def test_whole_report_against_search(spark, monkeypatch):
    rows = small_table()
    assert reported(spark, monkeypatch, rows) == brute(rows)


def test_blocks_of_long_conversations(spark, monkeypatch):
    """A conversation of many blocks gives what one block gives."""
    rows = small_table() + [(500, t, ["user", "assistant", "system"][(t * t) % 7 % 3], f"text {t % 50}" + "." * (t % 4 > 0)) for t in range(90)]
    want = brute(rows)
    monkeypatch.setattr(repair, "BLOCK", 3)
    assert reported(spark, monkeypatch, rows) == want


def test_empty_table(spark, monkeypatch):
    assert reported(spark, monkeypatch, []) == []


def test_dropped_conversation(spark, monkeypatch):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert reported(spark, monkeypatch, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("n", range(5))
def test_every_short_signature(n):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    walker, signatures = dawg.Suffixes(), sorted("".join(s) for s in itertools.product("DsuaxSUAX", repeat=n))
    for backwards in signatures:
        turns = [(names.get(c.lower(), "user"), "t", "blank" if c == "D" else "truncated" if c.isupper() else None) for c in reversed(backwards)]
        edits, cost, state = dawg.edits_from(walker.walk(backwards, dawg.END_COST), dawg.START)
        want = cheapest(turns)[:2]
        assert (cost + dawg.END_COST[state], (edits + dawg.END_EDITS[state]).translate(dawg.AUDIT)) == want
    # Every distinct suffix is one node, made once.
    assert walker.made == sum(9**k for k in range(1, n + 1))
