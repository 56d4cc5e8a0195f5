"""Queries of the corpus operators and their oracle SQL, by name."""

from tagweave.llm import (chat_format, decontaminate, license_scan, line_dedup, mixing, near_dedup, quality_rank,
                          quality_rules, substring_dedup, suffix_dedup, token_align, toxicity, whitening)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality_rank": quality_rank.op9_quality_rank,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_token_align": token_align.op13_token_align,
}

ORACLES = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
}
