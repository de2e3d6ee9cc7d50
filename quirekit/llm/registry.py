"""Queries of the subpackage and their DuckDB statements."""

from . import bpe, langid, neardup, packing, passages, quality, rules, secrets, topk, toxicity

QUERIES = {
    "op1_top_k": topk.op1_top_k,
    "op2_quality": quality.op2_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language": langid.op4_language,
    "op5_packing": packing.op5_packing,
    "op6_passages": passages.op6_passages,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_bpe": bpe.op8_bpe,
    "op9_secrets": secrets.op9_secrets,
    "op10_quality_rules": rules.op10_quality_rules,
    "secrets_base": secrets.secrets_base,
    "quality_rules_base": rules.quality_rules_base,
}

ORACLES = {
    "op1_top_k": topk.ORACLE,
    "op7_near_duplicates": neardup.ORACLE,
    "secrets_base": secrets.BASE_ORACLE,
    "quality_rules_base": rules.BASE_ORACLE,
}
