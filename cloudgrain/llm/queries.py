"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fingerprint, near_dedup, neighbours, pii, quality, repair, substring_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_chat_format": chat.op3_chat_format,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_bpe": bpe.op6_bpe,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_personal_data": pii.op8_personal_data,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_nearest": neighbours.op11_nearest,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op12_conversation_repair": repair.ORACLE,
}
