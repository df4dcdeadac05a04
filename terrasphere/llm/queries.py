"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasphere.llm import (
    contamination, kd_shards, lexical_search, line_dedup, main_text, near_copies, packing, personal_data, quality, repeated_spans, token_files, vector_codes, vector_links,
)

MODULES = (
    vector_links, near_copies, contamination, token_files, quality, kd_shards, personal_data, repeated_spans, main_text, packing,
    line_dedup, lexical_search, vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
