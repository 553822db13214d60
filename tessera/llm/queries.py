"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import decontam, language, licences, neardup, pieces, quality, secrets, sharding, tokenfiles, wordpiece


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_token_files": tokenfiles.op2_token_files,
        "op3_quality": quality.op3_quality,
        "op4_pieces": pieces.op4_pieces,
        "op5_token_counts": wordpiece.op5_token_counts,
        "op6_licences": licences.op6_licences,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_language": language.op8_language,
        "op9_secrets": secrets.op9_secrets,
        "op10_near_duplicates": neardup.op10_near_duplicates,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": quality.OP3_SQL,
        "op6_licences": licences.OP6_SQL,
        "op7_decontamination": decontam.OP7_SQL,
        "op10_near_duplicates": neardup.OP10_SQL,
    }
