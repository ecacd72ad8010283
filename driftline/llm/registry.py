"""Queries and oracle SQL of the numbered operators and the pipeline."""

from __future__ import annotations

from . import exact_dedup, lexical_search, minhash_dedup, neighbour_graph, piece_sampling, quality_classifier, quality_rules, source_mix, token_counts, toxicity, url_filters, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_minhash_neardup": minhash_dedup.op4_minhash_neardup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_warc": warc.op7_warc,
    "op8_sentencepiece": piece_sampling.op8_sentencepiece,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_neighbour_graph": neighbour_graph.op11_neighbour_graph,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE = {
    "op3_source_mix": source_mix.SQL,
    "op4_minhash_neardup": minhash_dedup.SQL,
    "op7_warc": warc.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op12_lexical_search": lexical_search.SQL,
}
