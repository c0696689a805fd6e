"""Queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from . import mixing, packing, quality_model, quality_rules, sharding, simhash, spotsigs, substrings, toxicity, url_filter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_substrings": substrings.op3_substrings,
    "op4_mixing": mixing.op4_mixing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
}
ORACLES = {"op4_mixing": mixing.oracle()}
