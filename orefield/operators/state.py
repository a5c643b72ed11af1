"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

ROWS = 1 << 20  # of a partition that dealt() makes


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir (a fresh folder where it is unset, as in tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orefield-"))
    return f"{context.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir (a fresh folder where it is unset, as in tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orefield-"))
    return df.checkpoint()


#: Spark's own setting: a finished query's shuffle files go at once, else only when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end meanwhile leave no shuffle files behind. For writes only: a table that is written needs none of them any more."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept as compressed columns in the shared folder: a checkpoint computes its last stage twice and writes whole rows."""
    path = shared_path(df.sparkSession, "stored")
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: Column | str, rows: int | None = None) -> DataFrame:
    """df by keys in partitions of about so many rows. Spark sizes partitions by their compressed bytes, so narrow rows would meet by many millions in one task.

    Counting the rows is one more pass over what df is made of.
    """
    return df.repartition(df.count() // (rows or ROWS) + 1, *keys)
