"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import licenses, line_dedup, media, mixing, near_dedup, sentencepiece_fst, token_binary, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_top_k": topk.op2_top_k,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_sentencepiece": sentencepiece_fst.op4_sentencepiece,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_media_chunks": media.op7_media_chunks,
    "op8_token_binary": token_binary.op8_token_binary,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op1_url_filter": url_filter.OP1_SQL, "op2_top_k": topk.OP2_SQL, "op3_line_dedup": line_dedup.OP3_SQL, "op5_license_scan": licenses.OP5_SQL, "op9_mix_sources": mixing.OP9_SQL}
