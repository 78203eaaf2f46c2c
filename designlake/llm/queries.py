"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chaining, decontam, divergence, language, mixing, pii, quality, repeats, sharding, simhash, tokens, urlfilter, variants


def queries() -> dict:
    return {f.__name__: f for f in (pii.op1_pii_sanitisation, tokens.op2_token_output, language.op3_language_id, sharding.op4_vector_sharding, decontam.op5_benchmark_decontamination, mixing.op6_source_mixing, quality.op7_quality_rules, simhash.op8_simhash_near_dedup, chaining.op9_substring_dedup, repeats.op10_repeated_substrings, divergence.op11_source_divergence, variants.op12_spelling_variants, urlfilter.op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": mixing.ORACLE, "op7_quality_rules": quality.ORACLE, "op11_source_divergence": divergence.ORACLE}
