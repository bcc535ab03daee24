"""Registered queries of the pipeline operators: each runs its operator over its whole table."""

from __future__ import annotations

from codedelta.llm import (decision_list, jaccard_join, license_scan, mixing, ordinal_quality, ranked_search, secret_forest, site_tree, token_counts,
                           token_store, warc, whitening, winnowing)

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_site_style_tree": site_tree.query,
    "op3_ngram_jaccard": jaccard_join.query,
    "op4_decision_list": decision_list.query,
    "op5_ordinal_quality": ordinal_quality.query,
    "op6_secret_forest": secret_forest.query,
    "op7_warc_transactions": warc.query,
    "op8_decontaminate": winnowing.query,
    "op9_token_attribution": token_counts.query,
    "op10_token_store": token_store.query,
    "op11_license_scan": license_scan.query,
    "op12_whitening": whitening.query,
    "op13_ranked_search": ranked_search.query,
}

#: DuckDB SQL for the operators that SQL can express; the others are tested against brute force.
ORACLE = {
    "op1_source_mix": mixing.ORACLE,
    "op7_warc_transactions": warc.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
