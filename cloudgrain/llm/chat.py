"""Chat formatting by perspective rotation.

Every participant of a conversation gets a rendering in which their turns are the
assistant's and all other participants' are named users'; system turns stay system
turns and are nobody's perspective. A rendering is the concatenation of its
segments in ``seq`` order; each segment carries its place in it, and the assistant's segments
also the masked part that is to be learnt: the text and its end mark.

A conversation may hold any share of the rows: a rendering is returned as one row per
segment, turns are numbered by ``rank_written``, and offsets are sums within blocks of ``BLOCK`` turns
plus the sums of the blocks before. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import join_on, rank_written
from .text import read

BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"


def rotate(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (conversation, participant, turn): conv_id, perspective, seq, turn, speaker, role, segment,
    start, end, mask_start, mask_end (characters in the rendering, ends exclusive; masks null where nothing is learnt).

    Turns are ordered by turn, speaker and text, nulls first; repeated rows are turns of
    their own. A null role is the participant ``unknown``, a null text is empty, a null
    conv_id is a conversation like others. A conversation of system turns alone has no
    perspective and no rows. Extra columns are ignored.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A few names per conversation; combined before the shuffle.
    participants = turns.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    ranked = rank_written(turns, ["conv_id"], ["turn", "speaker", "text"], out="seq").select("conv_id", "seq", "turn", "speaker", "text")
    seen = join_on(ranked, participants, ["conv_id"])
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    parts = seen.select(
        "conv_id", "perspective", "seq", "turn", "speaker", role.alias("role"), F.concat(head, "text", F.lit(END)).alias("segment"),
        F.length(head).cast("long").alias("_head"), F.expr(f"CAST((seq - 1) DIV {block} AS long)").alias("_block"),
    ).withColumn("_size", F.length("segment").cast("long"))
    keys = ["conv_id", "perspective"]
    sums = parts.groupBy(*keys, "_block").agg(F.sum("_size").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = join_on(parts.withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0))), bases, [*keys, "_block"])
    start = F.col("_base") + F.col("_within")
    end = start + F.col("_size")
    learnt = F.col("role") == "assistant"
    return placed.select(
        *keys, "seq", "turn", "speaker", "role", "segment", start.alias("start"), end.alias("end"),
        F.when(learnt, start + F.col("_head")).alias("mask_start"), F.when(learnt, end).alias("mask_end"),
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return rotate(read(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS speaker, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) AS seq FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
s AS (SELECT r.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '{START}' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM s),
g AS (SELECT *, head || text || '{END.strip()}' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS BIGINT) AS "end" FROM g)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, role, segment, "end" - length(segment) AS start, "end",
  CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN "end" END AS mask_end
FROM o
"""
