"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quillworks.llm import audio, centroids, codebooks, html_extraction, language_model, mixing, packing, quality_classifier, quality_rules, secret_spans, simhash, tokens, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_packing": packing.op2_packing,
    "op3_lm_scores": language_model.op3_lm_scores,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_chroma_search": audio.op9_chroma_search,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_secret_spans": secret_spans.op11_secret_spans,
    "op12_vector_codes": codebooks.op12_vector_codes,
    "op13_centroid_clusters": centroids.op13_centroid_clusters,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op7_mixing": mixing.op7_sql(),
    "op12_vector_codes": codebooks.op12_sql(),
    "op13_centroid_clusters": centroids.op13_sql(),
}
