"""The corpus operators' queries, by name, with their SQL oracles."""

from __future__ import annotations

from kinweave.llm import bpe, decontamination, importance, line_cleaning, line_dedup, minhash_forest, suffix_dedup, token_files, toxicity, url_filters

QUERIES = {
    "op2_suffix_dedup": suffix_dedup.op2,
    "op7_importance": importance.op7,
    "op9_toxicity": toxicity.op9,
    "op6_token_files": token_files.op6,
    "op3_url_filters": url_filters.op3,
    "op5_bpe": bpe.op5,
    "op10_minhash_forest": minhash_forest.op10,
    "op1_decontamination": decontamination.op1,
    "op4_line_dedup": line_dedup.op4,
    "op8_line_cleaning": line_cleaning.op8,
}

ORACLES = {
    "op3_url_filters": url_filters.ORACLE,
    "op1_decontamination": decontamination.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_line_cleaning": line_cleaning.oracle(),
}
