"""The registry of the engine's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import changepoint_queries, evaluation_queries, feature_queries, metric_queries, model_queries, research_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = [feature_queries, metric_queries, model_queries, changepoint_queries, research_queries, evaluation_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["feature_realized_volatility"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: v for part in PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.oracle_sql().items()}
