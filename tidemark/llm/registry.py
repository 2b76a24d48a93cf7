"""Queries of this subpackage: name -> (spark_fn(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from tidemark.llm import cover_codes, filter_audit, kneser_ney, language_id, line_dedup, mixing, nb_svm, ngram_jaccard, pivot_index, quality_rules, sentencepiece_chunks, sharding, toxicity

QUERIES = {
    "op6_lm_scoring": (kneser_ney.op6_lm_scoring, None),
    "op1_ngram_jaccard": (ngram_jaccard.op1_ngram_jaccard, None),
    "op5_line_dedup": (line_dedup.op5_line_dedup, line_dedup.SQL),
    "op10_toxicity": (toxicity.op10_toxicity, None),
    "op9_embedding_near_dedup": (pivot_index.op9_embedding_near_dedup, None),
    "op3_mixing": (mixing.op3_mixing, mixing.SQL),
    "op2_language_id": (language_id.op2_language_id, None),
    "op7_quality_rules": (quality_rules.op7_quality_rules, None),
    "op4_sentencepiece": (sentencepiece_chunks.op4_sentencepiece, None),
    "op8_sharding": (sharding.op8_sharding, sharding.SQL),
    "op11_filter_audit": (filter_audit.op11_filter_audit, filter_audit.SQL),
    "op12_quality_classifier": (nb_svm.op12_quality_classifier, None),
    "op13_vector_codes": (cover_codes.op13_vector_codes, cover_codes.SQL),
}
