"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import clustering, decontaminate, line_dedup, mixing, near_dup, quality, sharding, substring_exact, substring_near, tokens, toxicity, turns, url_filter

QUERIES = {
    "op1_token_output": tokens.op1_token_output,
    "op2_suffix_dedup": substring_exact.op2_suffix_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_near_dedup": near_dup.op5_near_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_substring_dedup": substring_near.op9_substring_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_sort_means": clustering.op11_sort_means,
    "op12_sampled_splitters": sharding.op12_sampled_splitters,
    "op13_turn_repair": turns.op13_turn_repair,
}

ORACLES = {
    "op3_decontamination": decontaminate.ORACLE,
    "op5_near_dedup": near_dup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_sort_means": clustering.ORACLE,
    "op12_sampled_splitters": sharding.ORACLE,
    "op13_turn_repair": turns.ORACLE,
}
