"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from quire.llm import op1_decontaminate, op2_lm, op3_bpe, op4_substrings, op5_html, op6_quality, op7_suffixes, op8_rules, op9_toxicity, op10_setsketch, op11_divergence, op12_codes, op13_imatch

QUERIES = {
    "op1_decontamination": op1_decontaminate.query,
    "op2_lm_scoring": op2_lm.query,
    "op3_bpe": op3_bpe.query,
    "op4_substring_dedup": op4_substrings.query,
    "op5_html_extraction": op5_html.query,
    "op6_quality_classifier": op6_quality.query,
    "op7_suffix_array_dedup": op7_suffixes.query,
    "op8_quality_rules": op8_rules.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_minhash_dedup": op10_setsketch.query,
    "op11_source_divergence": op11_divergence.query,
    "op12_vector_codes": op12_codes.query,
    "op13_document_fingerprints": op13_imatch.query,
    "lm_trigram_scores": op2_lm.rounded,
    "rule_ablations": op8_rules.ablations,
}
ORACLES = {
    "op1_decontamination": op1_decontaminate.ORACLE,
    "op4_substring_dedup": op4_substrings.ORACLE,
    "op7_suffix_array_dedup": op7_suffixes.ORACLE,
    "op8_quality_rules": op8_rules.ORACLE,
    "op10_minhash_dedup": op10_setsketch.ORACLE,
    "op11_source_divergence": op11_divergence.ORACLE,
    "op12_vector_codes": op12_codes.ORACLE,
    "lm_trigram_scores": op2_lm.ROUNDED,
    "rule_ablations": op8_rules.ABLATIONS,
}
