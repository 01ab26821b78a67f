"""The thin opN_<name> queries: each derives its columns from one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontaminate, language_id, license_scan, line_dedup, lm_score, media, minhash, mixing, prefix_trie, secret_scan, simhash, toxicity, vector_codes

_MODULES = (media, decontaminate, lm_score, secret_scan, license_scan, language_id, simhash, line_dedup, toxicity, mixing, minhash, vector_codes, prefix_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
