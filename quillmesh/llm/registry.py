"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from quillmesh.llm import decontamination, html_extract, jaccard_join, mixing, pii, quality_rules, ranked_search, secrets, suffix_dedup, suffix_tree_lm, token_output, url_filter, vector_codes

QUERIES: dict[str, Callable] = {
    "op1_pii": pii.op1_pii,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_lm_scoring": suffix_tree_lm.op4_lm_scoring,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_token_output": token_output.op10_token_output,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_url_filter": url_filter.op13_url_filter,
}

SQL: dict[str, str] = {
    "op11_vector_codes": vector_codes.sql(),
    "op12_ranked_search": ranked_search.sql(),
}
