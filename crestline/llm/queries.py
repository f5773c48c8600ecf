"""Queries of the training-data operators, by name, and the SQL that returns the same rows."""

from __future__ import annotations

from . import decontamination, divergence, exact_dedup, importance, license_scan, near_dedup, packing, quality_rules, spiece, substring_dedup, token_counts, token_output, toxicity

QUERIES = {
    "op1_toxicity": toxicity.q_toxicity,
    "op2_token_counts": token_counts.q_token_counts,
    "op3_exact_dedup": exact_dedup.q_exact_dedup,
    "op4_license_scan": license_scan.q_license_scan,
    "op5_packing": packing.q_pack,
    "op6_spiece": spiece.q_spiece,
    "op7_quality_rules": quality_rules.q_quality_rules,
    "op8_token_output": token_output.q_token_output,
    "op9_substring_dedup": substring_dedup.q_substring_dedup,
    "op10_near_dedup": near_dedup.q_near_dedup,
    "op11_divergence": divergence.q_divergence,
    "op12_importance": importance.q_importance,
    "op13_decontamination": decontamination.q_decontamination,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_divergence": divergence.SQL,
    "op12_importance": importance.SQL,
    "op13_decontamination": decontamination.SQL,
}
