"""The operators' queries and their SQL."""

from __future__ import annotations

from . import ann, chat, filter_audit, lexical, mixing, neardup, packing, passages, secrets, suffix_dedup, topk, toxicity, urlfilter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_multi_index": ann.op2_multi_index,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_chat_format": chat.op4_chat_format,
    "op5_url_filters": urlfilter.op5_url_filters,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_substring_dedup": passages.op9_substring_dedup,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_scan": secrets.op13_secret_scan,
}

SQL = {
    "op4_chat_format": chat.SQL,
    "op5_url_filters": urlfilter.SQL,
    "op8_mix_sources": mixing.SQL,
    "op10_exact_topk": topk.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
