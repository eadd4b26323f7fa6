"""Queries of the session engine and their DuckDB counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmix.plans import audit_queries, corpus_queries, deployment_queries, evaluation_queries, feature_queries, retrieval_queries, study_queries, wide_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (corpus_queries, retrieval_queries, feature_queries, evaluation_queries, study_queries, wide_queries, deployment_queries, audit_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
