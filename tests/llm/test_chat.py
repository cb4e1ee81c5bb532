from collections import defaultdict

from cloudgrain.llm import chat


def brute(rows):
    """(conv, perspective) -> (rendering, learnt pieces)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = {}
    for conv, turns in convs.items():
        for me in {r for *_, r, _ in turns} - {"system"}:
            text, learnt = "", []
            for *_, who, said in sorted(turns):
                text += "<|im_start|>" + ("assistant" if who == me else "system" if who == "system" else f"user name={who}") + "\n"
                if who == me:
                    learnt.append((len(text), len(text) + len(said) + len("<|im_end|>\n")))
                text += said + "<|im_end|>\n"
            out[conv, me] = text, learnt
    return out


def got(df):
    out = defaultdict(lambda: ["", []])
    for r in sorted(df.collect(), key=lambda r: r.seq):
        e = out[r.conv_id, r.perspective]
        assert r.start == len(e[0]) and r.end == r.start + len(r.segment)
        e[0] += r.segment
        if r.mask_start is not None:
            e[1].append((r.mask_start, r.mask_end))
    return {k: (v[0], v[1]) for k, v in out.items()}


def test_parties_ties_nulls_and_long_conversations(spark):
    rows = [(1, t, "abc"[t % 3], f"said {t} é😀") for t in range(50)]
    rows += [(2, 0, "system", "be brief"), (2, 1, "ann", "hi"), (2, 1, "ann", "hi"), (2, 1, "bob", None), (2, None, None, "early")]
    rows += [(None, 1, "x", "no id"), (None, 2, "y", "no id"), (3, 0, "system", "alone"), (4, 0, "solo", "word " * 4000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn int, role string, text string, speaker string, start string").repartition(3)
    want = brute(rows)
    assert got(chat.rotate(df)) == want
    assert got(chat.rotate(df, block=4)) == want
    assert chat.rotate(df.where("false")).count() == 0


def test_only_dataframe_functions(spark, sf):
    plan = chat.op3_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
