"""Queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunks, language, licences, media, mixing, neardup, negatives, ordering, quality, substrings, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_raked_mixture": mixing.op1_raked_mixture,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_line_hash_substring_dedup": substrings.op4_line_hash_substring_dedup,
    "op5_line_chunk_dedup": chunks.op5_line_chunk_dedup,
    "op6_signature_sniffing": media.op6_signature_sniffing,
    "op7_language_id": language.op7_language_id,
    "op8_training_order": ordering.op8_training_order,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_bagminhash_near_dup": neardup.op10_bagminhash_near_dup,
    "op11_warc": warc.op11_warc,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_whitening": whitening.op13_whitening,
}

#: The others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE,
    "op3_licence_scan": licences.ORACLE,
    "op4_line_hash_substring_dedup": substrings.ORACLE,
    "op5_line_chunk_dedup": chunks.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
}
