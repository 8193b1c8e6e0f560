"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from scriptorium.llm import chat, decontamination, divergence, exact_search, fill_in_middle, media, near_dup, piece_dropout, quality, sharding, token_counts, toxicity, url_filter

QUERIES = {
    "op1_string_kernel_toxicity": toxicity.op1_string_kernel_toxicity,
    "op2_merge_dropout_pieces": piece_dropout.op2_merge_dropout_pieces,
    "op3_edit_aware_token_counts": token_counts.op3_edit_aware_token_counts,
    "op4_bm25_decontamination": decontamination.op4_bm25_decontamination,
    "op5_chosen_path_near_dup": near_dup.op5_chosen_path_near_dup,
    "op6_transport_streams": media.op6_transport_streams,
    "op7_reply_trees": chat.op7_reply_trees,
    "op8_positive_unlabelled_quality": quality.op8_positive_unlabelled_quality,
    "op9_hypergeometric_shards": sharding.op9_hypergeometric_shards,
    "op10_redirect_equivalence": url_filter.op10_redirect_equivalence,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_exact_top_k": exact_search.op12_exact_top_k,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op5_chosen_path_near_dup": near_dup.ORACLE_SQL,
    "op7_reply_trees": chat.ORACLE_SQL,
    "op10_redirect_equivalence": url_filter.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_exact_top_k": exact_search.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
