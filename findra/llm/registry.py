"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP4_SQL, op4_decontamination
from .fingerprint import op7_fingerprint
from .jaccard_join import op2_jaccard_join
from .language_id import op6_language_id
from .license_scan import OP5_SQL, op5_license_scan
from .mixing import OP10_SQL, op10_mixing
from .quality import op9_quality
from .token_output import op8_token_output
from .toxicity import op1_toxicity
from .url_filter import op3_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_url_filter": op3_url_filter,
        "op4_decontamination": op4_decontamination,
        "op5_license_scan": op5_license_scan,
        "op6_language_id": op6_language_id,
        "op7_fingerprint": op7_fingerprint,
        "op8_token_output": op8_token_output,
        "op9_quality": op9_quality,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    """Those without SQL train models, hash shingles or write files; tests/llm holds them against brute force."""
    return {
        "op4_decontamination": OP4_SQL,
        "op5_license_scan": OP5_SQL,
        "op10_mixing": OP10_SQL,
    }
