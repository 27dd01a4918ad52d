"""Queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

from ledgerbeam.llm import (
    ann,
    chat,
    chat_repair,
    lexical_search,
    licenses,
    mixing,
    secrets,
    sentencepiece_scan,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_dedup,
)
from ledgerbeam.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_score_toxicity": toxicity.op1_score_toxicity,
    "op2_scan_secrets": secrets.op2_scan_secrets,
    "op3_sentencepiece": sentencepiece_scan.op3_sentencepiece,
    "op4_nearest_vectors": ann.op4_nearest_vectors,
    "op5_vector_dedup": vector_dedup.op5_vector_dedup,
    "op6_format_chats": chat.op6_format_chats,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_count_tokens": token_counts.op8_count_tokens,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_simhash_dedup": simhash.op10_simhash_dedup,
    "op11_rank_documents": lexical_search.op11_rank_documents,
    "op12_scan_licenses": licenses.op12_scan_licenses,
    "op13_repair_chats": chat_repair.op13_repair_chats,
}
