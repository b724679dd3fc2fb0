"""The training-data queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import byte_bpe, chat_format, exact_dedup, filter_audit, line_dedup, near_dedup, packing, quality, secrets, subwords, toxicity, url_filters, vector_codes

QUERIES = {
    "op2_subword_samples": subwords.op2_subword_samples,
    "op7_preference_format": chat_format.op7_preference_format,
    "op6_url_filters": url_filters.op6_url_filters,
    "op8_quality_rules": quality.op8_quality_rules,
    "op5_minmax_near_dedup": near_dedup.op5_minmax_near_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op1_toxicity": toxicity.op1_toxicity,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES = {
    "op7_preference_format": chat_format.OP7_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
