"""Queries of this subpackage and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmix.llm import (
    byte_bpe, fingerprints, ngram_join, packing, quality, resampling, secrets, substrings, token_counts, topk_search, toxicity, warc,
    whitening,
)
from trailmix.llm.common import shipped

_MODULES = (ngram_join, byte_bpe, fingerprints, token_counts, secrets, substrings, quality, warc, toxicity, packing, topk_search, resampling, whitening)


def _with_code(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES[_module.NAME] = _with_code(_module.query)
    if getattr(_module, "ORACLE", None):
        ORACLES[_module.NAME] = _module.ORACLE
