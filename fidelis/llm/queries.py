"""Queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from fidelis.llm import (
    compression_classifier,
    decontamination,
    license_scan,
    line_dedup,
    lm_scoring,
    near_dup,
    quality_rules,
    sentencepiece,
    substring_dedup,
    warc,
)
from fidelis.session import ship


def _shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    all_of = (
        quality_rules.op1_quality_rules,
        license_scan.op2_license_scan,
        sentencepiece.op3_sentencepiece,
        substring_dedup.op4_substring_dedup,
        compression_classifier.op5_quality_classifier,
        decontamination.op6_decontamination,
        line_dedup.op7_line_dedup,
        near_dup.op8_minhash,
        warc.op9_warc,
        lm_scoring.op10_lm_scoring,
    )
    return {q.__name__: _shipped(q) for q in all_of}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.op1_sql(),
        "op4_substring_dedup": substring_dedup.op4_sql(),
        "op8_minhash": near_dup.op8_sql(),
        "op9_warc": warc.op9_sql(),
    }
