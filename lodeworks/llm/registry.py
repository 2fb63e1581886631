"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroid_clusters, fingerprints, jaccard_join, language_id, lexical_search, minhash_dedup, mixing, pii, subwords, token_counts, toxicity, url_filters, vector_search

QUERIES = {
    "op1_sentencepiece": subwords.op1_sentencepiece,
    "op2_pii": pii.op2_pii,
    "op3_topk": vector_search.op3_topk,
    "op4_language_id": language_id.op4_language_id,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_ngram_join": jaccard_join.op9_ngram_join,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_minhash_dedup": minhash_dedup.op11_minhash_dedup,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_centroid_clusters": centroid_clusters.op13_centroid_clusters,
}
ORACLE_SQL: dict[str, str] = {
    "op3_topk": vector_search.SQL,
    "op5_mixing": mixing.sql(),
    "op7_url_filters": url_filters.SQL,
    "op12_lexical_search": lexical_search.SQL,
    "op13_centroid_clusters": centroid_clusters.SQL,
}
