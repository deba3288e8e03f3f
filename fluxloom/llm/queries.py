"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, decontamination, fill_in_middle, importance, jaccard_join, license_scan, mixing, oracle, quality_classifier, quality_rules, suffix_dedup, token_files, warc, window_dedup

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_line_frequency_rules": quality_rules.op3_line_frequency_rules,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_positional_index_decontamination": decontamination.op5_positional_index_decontamination,
    "op6_bpe_speculate_verify": bpe.op6_bpe_speculate_verify,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_bradley_terry_quality": quality_classifier.op8_bradley_terry_quality,
    "op9_count_min_window_dedup": window_dedup.op9_count_min_window_dedup,
    "op10_simple8b_token_files": token_files.op10_simple8b_token_files,
    "op11_rope_fill_in_middle": fill_in_middle.op11_rope_fill_in_middle,
    "op12_dsir_resampling": importance.op12_dsir_resampling,
    "op13_water_filled_mix": mixing.op13_water_filled_mix,
}
#: SQL gives neither fuzzy labels (1), the library's ids (6, 10), nor a fitted model (8); over all bytes (7) it takes too much memory.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": oracle.OP2,
    "op3_line_frequency_rules": oracle.OP3,
    "op4_warc_salvage": oracle.OP4,
    "op5_positional_index_decontamination": oracle.OP5,
    "op9_count_min_window_dedup": oracle.OP9,
    "op11_rope_fill_in_middle": oracle.OP11,
    "op12_dsir_resampling": oracle.OP12,
    "op13_water_filled_mix": oracle.OP13,
}
