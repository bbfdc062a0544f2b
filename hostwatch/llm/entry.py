"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostwatch.llm import chat, decontaminate, fim, line_dedup, lm_score, mixing, near_dedup, quality, repetition, suffix_dedup, token_counts, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        line_dedup.op1_line_dedup, quality.op2_quality, chat.op3_chat_format, decontaminate.op4_decontaminate, repetition.op5_quality_rules,
        warc.op6_warc, mixing.op7_mixing, lm_score.op8_lm_score, suffix_dedup.op9_suffix_dedup, near_dedup.op10_near_dedup,
        token_counts.op11_token_counts, fim.op12_fill_in_middle, variants.op13_spelling_variants,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in (line_dedup, quality, chat, decontaminate, repetition, warc, mixing, lm_score, suffix_dedup, near_dedup, token_counts, fim, variants):
        out |= m.SQL
    return out
