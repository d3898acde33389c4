"""The queries of the corpus operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewheel.llm import chat, mixing, pii, quality, sharding, simhash, token_files, toxicity, urlfilter, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": pii.query,
    "op2_source_mixing": mixing.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_shard_packing": sharding.query,
    "op5_quality_rules": quality.query,
    "op6_url_filters": urlfilter.query,
    "op7_decontamination": winnow.query,
    "op8_token_binary": token_files.query,
    "op9_toxicity": toxicity.query,
    "op10_chat_format": chat.query,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": quality.ORACLE,
    "op6_url_filters": urlfilter.ORACLE,
    "op7_decontamination": winnow.ORACLE,
    "op10_chat_format": chat.ORACLE,
}
