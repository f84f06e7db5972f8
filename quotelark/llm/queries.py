"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quotelark.llm import op1_language_id, op2_substring_dedup, op3_toxicity, op4_brown_lm, op5_quality, op6_jaccard, op7_fingerprints, op8_chat, op9_decontamination, op10_mixing, op11_token_files, op12_periodic_runs, op13_hard_negatives

QUERIES = {
    "op1_language_id": op1_language_id.query,
    "op2_substring_dedup": op2_substring_dedup.query,
    "op3_toxicity": op3_toxicity.query,
    "op4_brown_lm": op4_brown_lm.query,
    "op5_quality": op5_quality.query,
    "op6_jaccard": op6_jaccard.query,
    "op7_fingerprints": op7_fingerprints.query,
    "op8_chat": op8_chat.query,
    "op9_decontamination": op9_decontamination.query,
    "op10_mixing": op10_mixing.query,
    "op11_token_files": op11_token_files.query,
    "op12_periodic_runs": op12_periodic_runs.query,
    "op13_hard_negatives": op13_hard_negatives.query,
}

ORACLE_SQL = {"op8_chat": op8_chat.ORACLE, "op10_mixing": op10_mixing.ORACLE, "op13_hard_negatives": op13_hard_negatives.ORACLE}
