"""Exact quantiles and average ranks of groups of any size.

Values are counted first, so a tie is one row. The different values are dealt into ranges in order of group and value; ranges add
up inside themselves and each starts from the sizes of those before it. No task holds a group, and what is added
up over all ranges is one row a range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import stored


def _same(by: Sequence[str], left: DataFrame | None = None, prefix: str = "_of_") -> list[Column]:
    return [F.col(b).eqNullSafe(F.col(f"{prefix}{b}")) for b in by]


def _named(df: DataFrame, by: Sequence[str], *columns: Column | str) -> DataFrame:
    return df.select(*[F.col(b).alias(f"_of_{b}") for b in by], *columns)


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """left joined with right on by (NULL equals NULL); right holds the by columns as _of_<name>. Without by, right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    return left.join(right, _same(by), how).drop(*[f"_of_{b}" for b in by])


def cumulative(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(by, value, n, before): each different value of a group with its rows (or weight) and those of smaller values. Missing values are left out."""
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    order = [F.col(c).asc_nulls_first() for c in [*by, value]]
    # range boundaries are sampled, so all uses below must see the same ranges
    split = stored(stored(counts).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("_part", *by).agg(F.sum("n").alias("_size"))  # one row a range and group
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    starts = _named(starts, by, F.col("_part").alias("_p"), "_start")
    j = split.join(starts, [F.col("_part") == F.col("_p"), *_same(by)])
    return j.select(*by, value, "n", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("_start")).alias("before"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float], names: Sequence[str], weight: str | None = None) -> DataFrame:
    """(by, names): exact quantiles, with linear interpolation between the two ranks around level * (n - 1), for each group with a value."""
    ranked = stored(cumulative(df, by, value, weight))
    sizes = ranked.groupBy(*by).agg(F.sum("n").alias("_total"))
    j = _beside(ranked, _named(sizes, by, "_total"), by, "inner")
    picks = []
    for level, name in zip(levels, names):
        at = F.lit(float(level)) * (F.col("_total") - 1)
        holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value)))
        picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return j.groupBy(*by).agg(*picks)


def average_rank(df: DataFrame, by: Sequence[str], value: str, eligible: Column | None = None, name: str = "percentile") -> DataFrame:
    """df with the average rank of its value over the number of eligible rows with a value in its group; NULL for other rows. Ties share the mean rank."""
    ok = F.col(value).isNotNull() if eligible is None else F.coalesce(eligible, F.lit(False)) & F.col(value).isNotNull()
    marked = df.withColumn("_ok", ok)
    ranked = stored(cumulative(marked.where("_ok"), by, value))
    totals = ranked.groupBy(*by).agg(F.sum("n").alias("_total"))
    shares = _beside(ranked, _named(totals, by, "_total"), by, "inner").withColumn("_share", (F.col("before") + (F.col("n") + 1) / 2.0) / F.col("_total"))
    named = _named(shares, by, F.col(value).alias("_value"), "_share")
    on = [*_same(by), F.col("_ok") & (F.col(value) == F.col("_value"))]
    return marked.join(named.hint("merge"), on, "left").drop(*[f"_of_{b}" for b in by], "_ok", "_value").withColumnRenamed("_share", name)
