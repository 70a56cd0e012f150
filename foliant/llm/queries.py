"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from foliant.llm import byte_bpe, language_id, license_scan, line_dedup, media_columns, minhash_dedup, mixing, quality_rules, sharding, suffix_dedup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_media_columns": media_columns.op6_media_columns,
    "op7_language_id": language_id.op7_language_id,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

#: None where SQL cannot express the operator.
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.oracle_sql(),
    "op3_license_scan": license_scan.oracle_sql(),
    "op4_line_dedup": line_dedup.oracle_sql(),
    "op5_mixing": mixing.oracle_sql(),
    "op8_minhash_dedup": minhash_dedup.oracle_sql(),
    "op10_quality_rules": quality_rules.oracle_sql(),
}
