"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, media, ngram_join, packing, pii, substrings, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": token_files.query,
        "op2_ngram_join": ngram_join.query,
        "op3_warc_revisits": warc.query,
        "op4_media_tiles": media.query,
        "op5_pseudonyms": pii.query,
        "op6_decontamination": decontaminate.query,
        "op7_packing": packing.query,
        "op8_language": langid.query,
        "op9_substrings": substrings.query,
        "op10_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_revisits": warc.SQL}
