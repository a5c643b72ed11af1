"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.state import shuffles_freed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orefield-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, short lineage, survives lost executors. options go to the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _plain(column: pa.Array) -> np.ndarray:
    """A numpy column; with nulls, one of objects (never of floats, which would round integers)."""
    return np.array([*column.to_pylist(), None], object)[:-1] if column.null_count else column.to_numpy(zero_copy_only=False)


def key_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole groups of rows with equal keys from batches sorted by key: (columns, group starts plus end).

    A group is never cut: the last group of a batch is held back until its end is seen.
    Binary columns come as object arrays.
    """
    held: list[dict[str, np.ndarray]] = []

    def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def cut(rows: dict[str, np.ndarray]) -> np.ndarray:
        keys = rows[key]
        return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {n: _plain(batch.column(i)) for i, n in enumerate(batch.schema.names)}
        if held and rows[key][-1] == held[-1][key][-1]:
            held.append(rows)
            continue
        rows = joined([*held, rows])
        last = cut(rows)[-2]
        if last:
            done = {c: v[:last] for c, v in rows.items()}
            yield done, cut(done)
        held = [{c: v[last:] for c, v in rows.items()}]
    if held:
        rows = joined(held)
        yield rows, cut(rows)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes in a text or binary column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_text_columns(docs: DataFrame, text_col: str, fields: str, function: Callable[[list[bytes]], list[pa.Array]], part_bytes: int = 8 << 20) -> DataFrame:
    """docs with columns (DDL in fields) that function makes from parts of the texts; columns of those names are replaced."""
    added = StructType.fromDDL(fields)
    docs = docs.drop(*added.fieldNames())
    schema = StructType(docs.schema.fields + added.fields)
    at = docs.columns.index(text_col)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at, part_bytes):
                made = [*b.columns, *function(as_bytes(b.column(at)))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target)], schema=target)

    return docs.mapInArrow(run, schema)


def beside(docs: DataFrame, own: Iterable[str], act: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of act(docs) with the columns of docs. Those that clash with columns that act adds (own) are kept aside meanwhile."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c in set(own)}
    return act(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of (src, dst) as (node, component): the component's smallest node.

    Large-star and small-star steps alternate until the edges no longer change. Each step is
    grouped minima and joins on node ids; nothing but a count and a checksum reaches the driver.
    Nodes without an edge to another node do not appear.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = written(pairs, f"{tag}-edges")
    seen = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.join(low, both.u == low.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.c).select("v", "c", "m")
        star = small.select(F.col("c").alias("u"), F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        pairs = written(star, f"{tag}-edges")
        now = tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as bigint))")).first())
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


Batches = Iterator[pa.RecordBatch]
BatchFunction = Callable[[Batches], Batches]
