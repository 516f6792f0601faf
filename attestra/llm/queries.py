"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from . import alignment, exact_dedup, hard_negatives, html_extraction, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, tokens, topk_search

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_html_extraction": html_extraction.op10_html_extraction,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_exact_topk": topk_search.op12_exact_topk,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {"op2_exact_dedup": exact_dedup.SQL, "op7_line_dedup": line_dedup.SQL, "op12_exact_topk": topk_search.SQL, "op13_hard_negatives": hard_negatives.SQL}
