"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from . import ball_kmeans, bpe, byte_bpe, decontamination, filter_audit, language_id, lm_scoring, simhash, substring_dedup, suffix_dedup, topk_search, toxicity, warc

QUERIES = {
    "op1_bpe_encoding": bpe.query,
    "op2_benchmark_decontamination": decontamination.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op5_language_id": language_id.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_topk_search": topk_search.query,
    "op8_lm_scoring": lm_scoring.query,
    "op9_warc": warc.query,
    "op10_toxicity": toxicity.query,
    "op11_ball_kmeans": ball_kmeans.query,
    "op12_byte_bpe": byte_bpe.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLE_SQL = {
    "op2_benchmark_decontamination": decontamination.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op7_topk_search": topk_search.SQL,
    "op9_warc": warc.SQL,
    "op11_ball_kmeans": ball_kmeans.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
