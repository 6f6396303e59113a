"""All registered queries; importing the modules below fills the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statloom.plans import core_queries, derive_queries, job_queries, ranking_queries, registry, scoring_queries, search_queries, stream_queries, term_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
