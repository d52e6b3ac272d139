"""Registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritally.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    language_id,
    license_digests,
    line_dedup,
    lm_scoring,
    minhash_hamming,
    quality_ledger,
    run_index_dedup,
    source_mix,
    tokenizer_alignment,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_scoring.query,
        "op2_line_dedup": line_dedup.query,
        "op3_run_index_dedup": run_index_dedup.query,
        "op4_license_digests": license_digests.query,
        "op5_minhash_hamming": minhash_hamming.query,
        "op6_language_id": language_id.query,
        "op7_toxicity": toxicity.query,
        "op8_quality_ledger": quality_ledger.query,
        "op9_source_mix": source_mix.query,
        "op10_decontamination": decontamination.query,
        "op11_tokenizer_alignment": tokenizer_alignment.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_byte_bpe": byte_bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_scoring": lm_scoring.ORACLE_SQL,
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op3_run_index_dedup": run_index_dedup.ORACLE_SQL,
        "op4_license_digests": license_digests.ORACLE_SQL,
        "op5_minhash_hamming": minhash_hamming.ORACLE_SQL,
        "op8_quality_ledger": quality_ledger.ORACLE_SQL,
        "op9_source_mix": source_mix.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    }
