"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, license, lm_score, ngram_join, pii, quality, secrets, substring, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_lm_scoring": lm_score.op6_lm_scoring,
    "op7_license_scan": license.op7_license_scan,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_pii": pii.op9_pii,
    "op10_url_filter": url_filter.op10_url_filter,
}
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": ngram_join.SQL,
    "op5_quality_rules": quality.SQL,
    "op7_license_scan": license.SQL,
    "op8_substring_dedup": substring.SQL,
    "op10_url_filter": url_filter.SQL,
}
