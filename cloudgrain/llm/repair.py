"""Repair of conversations to the order ``(s?(ua)+)?`` of roles, with the cheapest edits.

Faults become signature symbols; blocks of ``BLOCK`` turns from a conversation's end are its signatures,
as a conversation may hold any share of the rows. Each distinct signature is looked at once, whatever
the number of conversations that have it, in an order in which shared suffixes (``dawg``) lie next to each other:
first for the cost between any two grammar states, from which the cost to go at every block's end follows, then, once per
signature and cost to go, for the edits. Only these narrow columns are streamed conversation by conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import join_on, rank_written
from ..storage import settle
from . import dawg
from .text import read

BLOCK = 256
_WORD, _CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_LEGAL = {"su", "ua", "au"}


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) with faults planted by crc32 of ``conv_id:turn``; nulls count as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    kinds = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return kinds.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def ranked_turns(turns: DataFrame) -> DataFrame:
    """Turns in order with ``pos`` (from 1), ``block`` (from the end) and ``symbol`` and ``fault`` of each. Written once."""
    rows = turns.withColumn("mark", F.md5(F.col("text").cast("binary")))
    laid = rank_written(rows, ["conv_id"], ["turn", "role", "mark", "copy"], out="pos", total="n")
    seen = laid.groupBy("conv_id", "role", "mark").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    laid = join_on(laid, seen, ["conv_id", "role", "mark"], "left")
    fault = (F.when(~F.col("text").rlike(_WORD), "blank").when(F.col("pos") > F.col("first"), "duplicate")
             .when(~F.col("text").rlike(_CLOSED), "truncated"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    rows = laid.withColumn("fault", fault).withColumn("kind", kind)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind"))
    return rows.select("conv_id", "turn", "pos", "role", "text", "fault", "kind", symbol.alias("symbol"), F.expr(f"CAST((n - pos) DIV {BLOCK} AS long)").alias("block"))


def _joined(order: Column, letter: str) -> Column:
    """Letters of a block's turns in ``order``; at most ``BLOCK``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(letter).alias("x")))), lambda e: e.x), "")


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _costs(signatures: DataFrame) -> DataFrame:
    """(signature, costs) of distinct signatures: from each state before to each state after."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walkers = [dawg.Suffixes() for _ in range(dawg.STATES)]
        for batch in batches:
            costs = [list(dawg.costs_between(walkers, s)) for s in _column(batch, "signature")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64()))], names=["signature", "costs"])

    return signatures.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(look, "signature string, costs array<long>")


def _exits(blocks: DataFrame) -> DataFrame:
    """Blocks with ``ends``: the cost to go from each state after a block, less the least of them."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = dawg.END_COST
        for batch in batches:
            ends = []
            for block, between in zip(_column(batch, "block"), _column(batch, "costs")):
                if block == 0:
                    costs = dawg.END_COST
                ends.append(",".join(map(str, costs)))
                n = dawg.STATES
                go = [min(between[n * q + e] + costs[e] for e in range(n)) for q in range(n)]
                costs = tuple(c - min(go) for c in go)
            yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "block", "signature", "kinds"]).columns, pa.array(ends, pa.string())], names=["conv_id", "block", "signature", "kinds", "ends"])

    streamed = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "block", "signature", "kinds", "costs")
    return streamed.mapInArrow(stream, f"conv_id {kind}, block long, signature string, kinds string, ends string")


def _edits(cases: DataFrame) -> DataFrame:
    """(signature, ends, ways) of distinct cases: edits, cost and state after it from each state before."""
    way = pa.struct([("edits", pa.string()), ("cost", pa.int64()), ("after", pa.int32())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = dawg.Suffixes()
        for batch in batches:
            ways = []
            for signature, ends in zip(_column(batch, "signature"), _column(batch, "ends")):
                nodes = walker.walk(signature, tuple(map(int, ends.split(","))))
                ways.append([dict(zip(("edits", "cost", "after"), dawg.edits_from(nodes, q))) for q in range(dawg.STATES)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ways, pa.list_(way))], names=["signature", "ends", "ways"])

    rows = cases.select("signature", "ends").distinct().repartitionByRange("ends", "signature").sortWithinPartitions("ends", "signature")
    return rows.mapInArrow(look, "signature string, ends string, ways array<struct<edits: string, cost: long, after: int>>")


def _chosen(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, edits, tail, cost, illegal): the way of each block that starts in the state the blocks before it end in."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, known = dawg.START, "", None
        for batch in batches:
            out = {k: [] for k in ("edits", "tail", "cost", "illegal")}
            for conv, block, kinds, ways in zip(*[_column(batch, c) for c in ("conv_id", "block", "kinds", "ways")]):
                if known != (conv,):
                    state, last, known = dawg.START, "", (conv,)
                way = ways[state]
                pairs = last + kinds
                out["illegal"].append(sum(pairs[i:i + 2] not in _LEGAL for i in range(len(pairs) - 1)))
                state, last = way["after"], kinds[-1]
                out["edits"].append(way["edits"])
                out["tail"].append(dawg.END_EDITS[state] if block == 0 else "")
                out["cost"].append(way["cost"] + (dawg.END_COST[state] if block == 0 else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(out["edits"], pa.string()), pa.array(out["tail"], pa.string()), pa.array(out["cost"], pa.int64()), pa.array(out["illegal"], pa.int64())],
                names=["conv_id", "block", *out])

    streamed = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).select("conv_id", "block", "kinds", "ways")
    return streamed.mapInArrow(stream, f"conv_id {kind}, block long, edits string, tail string, cost long, illegal long")


def plan_edits(ranked: DataFrame) -> DataFrame:
    """Edits of every block of turns: (conv_id, block, edits, tail, cost, illegal); ``tail`` is inserted after the last turn."""
    blocks = settle(ranked.groupBy("conv_id", "block").agg(_joined(-F.col("pos"), "symbol").alias("signature"), _joined(F.col("pos"), "kind").alias("kinds")))
    costs = _costs(blocks.select("signature").distinct())
    ended = settle(_exits(blocks.join(costs, "signature")))
    return settle(_chosen(ended.join(_edits(ended), ["signature", "ends"])))


def repaired_turns(ranked: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns of the repaired conversations: (conv_id, pos, part, role, text); inserted turns have no text. Order: pos, part."""
    own = F.regexp_extract_all("edits", F.lit("([ua]*[KDUA])"), 1)
    # The block's first turn is the one with the least pos; turns of a block are numbered from it.
    firsts = ranked.groupBy("conv_id", "block").agg(F.min("pos").alias("_first"))
    rows = join_on(ranked, join_on(edits.select("conv_id", "block", "edits"), firsts, ["conv_id", "block"]), ["conv_id", "block"])
    rows = rows.withColumn("_own", F.get(own, (F.col("pos") - F.col("_first")).cast("int")))
    parts = rows.select("conv_id", "pos", "role", "text", F.posexplode(F.split("_own", "")).alias("part", "_edit")).where("_edit IN ('u', 'a', 'K', 'U', 'A')")
    role = F.when(F.lower("_edit") == "u", "user").when(F.lower("_edit") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("_edit").isin("u", "a"), "").otherwise(F.col("text"))
    turns = parts.select("conv_id", "pos", "part", role.alias("role"), text.alias("text"))
    last = F.lit((1 << 63) - 1)
    tail = edits.select("conv_id", F.posexplode(F.split("tail", "")).alias("part", "_edit")).where("_edit <> ''")
    return turns.unionByName(tail.select("conv_id", last.alias("pos"), "part", F.when(F.col("_edit") == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines. SHA-256 runs from start to end, so a conversation streams through one task, turn by turn."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest, field = None, None, None
        for batch in batches:
            field = batch.schema.field("conv_id").type
            done = []
            for conv, line in zip(_column(batch, "conv_id"), _column(batch, "line")):
                if known != (conv,):
                    if known:
                        done.append((known[0], digest.hexdigest()))
                    known, digest = (conv,), hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], field), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([known[0]], field), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    lines = turns.select("conv_id", "pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part").select("conv_id", "line")
    return ordered.mapInArrow(stream, f"conv_id {kind}, repaired_sha256 string")


def report(ranked: DataFrame, edits: DataFrame) -> DataFrame:
    """Per conversation: gaps, counted faults, illegal neighbours, cost and audit."""
    count = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    faults = ranked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("block")).alias("o"), F.concat("edits", "tail").alias("x")))), lambda e: e.x), "")
    audits = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.translate(whole, "uaUA", "IIRR").alias("audit"))
    return join_on(faults, audits, ["conv_id"])


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Report on the repair of every damaged conversation.

    Turns are ordered by turn (nulls first), role and the md5 of their text, copies of a row next to each other; repeated rows are
    duplicates. Null roles and texts are one space, which is a blank text and a role of no class. A null conv_id is a
    conversation like others. An empty table has no rows. Extra columns are ignored.
    """
    conversations = read(spark, sf_dir, "conversations")
    ranked = settle(ranked_turns(damage(conversations)))
    edits = plan_edits(ranked)
    found = join_on(report(ranked, edits), digests(repaired_turns(ranked, edits)), ["conv_id"], "left")
    out = join_on(conversations.select("conv_id").distinct(), found, ["conv_id"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _least(*ways: tuple[str, str, str, str]) -> str:
    """SQL of the least (cost, audit, edits) of ways (condition, cost, edit, state after it)."""
    letter = lambda e: e.translate(dawg.AUDIT)
    made = [f"CASE WHEN {cond} THEN {{'c': {cost} + {to}.c, 'a': '{letter(edit)}' || {to}.a, 'e': '{edit}' || {to}.e}} ELSE {{'c': {dawg.FAR}, 'a': '', 'e': ''}} END" for cond, cost, edit, to in ways]
    return f"list_sort([{', '.join(made)}])[1]"


_FREE = "symbol <> 'D'"
_OWN = [
    _least(("true", "4", "D", "f0"), (f"{_FREE} AND kind = 's'", "late", "K", "f1"), (f"{_FREE} AND kind = 'u'", "late", "K", "f2"), (_FREE, "3 + late", "U", "f2")),
    _least(("true", "4", "D", "f1"), (f"{_FREE} AND kind = 'u'", "late", "K", "f2"), (_FREE, "3 + late", "U", "f2")),
    _least(("true", "4", "D", "f2"), (f"{_FREE} AND kind = 'a'", "late", "K", "f3"), (_FREE, "3 + late", "A", "f3")),
    _least(("true", "4", "D", "f3"), (f"{_FREE} AND kind = 'u'", "late", "K", "f2"), (_FREE, "3 + late", "U", "f2")),
]
_ALL = [
    _least(("true", "0", "", "g0"), ("true", "3", "u", "g2"), ("true", "6", "ua", "g3")), _least(("true", "0", "", "g1"), ("true", "3", "u", "g2"), ("true", "6", "ua", "g3")),
    _least(("true", "0", "", "g2"), ("true", "3", "a", "g3"), ("true", "6", "au", "g2")), _least(("true", "0", "", "g3"), ("true", "3", "u", "g2"), ("true", "6", "ua", "g3")),
]

ORACLE = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
dealt AS (SELECT conv_id, turn, role, text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM dealt WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS kind FROM placed),
turns AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' ELSE kind END AS symbol, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late,
  coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) || kind NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
go AS (
  SELECT conv_id, max(pos) + 1 AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'e': ''}} AS f0, {{'c': CAST(6 AS BIGINT), 'a': 'II', 'e': 'ua'}} AS f1, {{'c': CAST(3 AS BIGINT), 'a': 'I', 'e': 'a'}} AS f2, {{'c': CAST(0 AS BIGINT), 'a': '', 'e': ''}} AS f3
  FROM turns GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, {_ALL[0]}, {_ALL[1]}, {_ALL[2]}, {_ALL[3]}
  FROM (SELECT g.conv_id, t.pos, {_OWN[0]} AS g0, {_OWN[1]} AS g1, {_OWN[2]} AS g2, {_OWN[3]} AS g3
    FROM go g JOIN turns t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.pos = g.pos - 1)),
best AS (SELECT conv_id, f0.c AS cost, f0.a AS audit, f0.e AS edits FROM go WHERE pos = 1),
chars AS (SELECT t.conv_id, pos, role, text, unnest(string_split(regexp_extract_all(edits, '[ua]*[KDUA]')[pos], '')) AS edit, generate_subscripts(string_split(regexp_extract_all(edits, '[ua]*[KDUA]')[pos], ''), 1) AS part
  FROM turns t JOIN best b ON t.conv_id IS NOT DISTINCT FROM b.conv_id
  UNION ALL
  SELECT conv_id, 1000000000000000000, '', '', unnest(string_split(regexp_extract(edits, '[ua]*\z'), '')), generate_subscripts(string_split(regexp_extract(edits, '[ua]*\z'), ''), 1) FROM best),
lines AS (SELECT conv_id, pos, part, CASE edit WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' WHEN 'U' THEN 'user:' || text WHEN 'A' THEN 'assistant:' || text ELSE role || ':' || text END AS line
  FROM chars WHERE edit NOT IN ('D', '')),
repaired AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos, part)) AS digest FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM turns GROUP BY conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM convs v LEFT JOIN counts c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON v.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON v.conv_id IS NOT DISTINCT FROM r.conv_id
"""
