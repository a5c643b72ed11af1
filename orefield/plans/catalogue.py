"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import registry, scalar_queries, science_queries, table_queries  # noqa: F401  importing registers the queries


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return registry.QUERIES["w2_top_k_per_row"](spark, folder)
