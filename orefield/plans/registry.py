"""Names of queries, their functions and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import PRELUDE, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures. sql continues the views' WITH list: it begins with SELECT, or with a comma and more tables."""

    def add(f: Callable[[Fixtures], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: f(Fixtures(spark, folder))
        if sql:
            ORACLES[name] = f"{PRELUDE}\n{sql}"
        return f

    return add


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371.0088e0 * asin(sqrt(least(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 1e0))))"


#: Even-odd crossings of edges e around a point (px, py), as a boolean aggregate.
def inside(px: str, py: str) -> str:
    return f"sum(CASE WHEN (e.y1 > {py}) <> (e.y2 > {py}) AND {px} < (e.x2 - e.x1) * ({py} - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1"
