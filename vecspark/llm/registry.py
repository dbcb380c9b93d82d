"""The corpus queries by name, with their SQL twins where SQL can express them."""

from vecspark.llm import (
    jaccard_join,
    lm_scoring,
    mixing,
    order_minhash,
    packing,
    pipeline,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    url_filter,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_quality_classifier": quality_classifier.op2,
    "op3_sharding": sharding.op3,
    "op4_quality_rules": quality_rules.op4,
    "op5_url_filter": url_filter.op5,
    "op6_mixing": mixing.op6,
    "op7_lm_scoring": lm_scoring.op7,
    "op8_packing": packing.op8,
    "op9_order_minhash": order_minhash.op9,
    "op10_ngram_jaccard_join": jaccard_join.op10,
    "pipeline": pipeline.run,
}

ORACLES = {
    "op3_sharding": sharding.OP3_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
}
