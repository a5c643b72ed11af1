"""Spatial folds: whole groups dealt to folds of even size."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import materialised


def deal(classes: Iterable[tuple[int, int, int]], folds: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(p, n, fold, first, last): places of a class that a fold takes.

    classes are (positives, rows, groups) of groups that are alike, most positives and rows first. Each group goes to the fold with the
    fewest positives (if it has any), then the fewest rows, then the lowest number. Groups of a class are interchangeable, so only each fold's number of them
    is found, and the folds take the class's places in turn. Once the folds lie within one group of one another the greedy order repeats itself, and whole
    cycles are counted instead of walked.
    """
    loads = [[0, 0] for _ in range(folds)]
    for p, n, m in classes:
        heap = [(*(load if p else load[1:]), f) for f, load in enumerate(loads)]
        heapq.heapify(heap)
        step, taken, left = (p, n) if p else (n,), [0] * folds, m
        while left:
            if max(heap)[0] - heap[0][0] <= step[0] and left > 2 * folds:
                low, high = heap[0], max(heap)
                if tuple(a + b for a, b in zip(low[:-1], step)) >= high[:-1]:
                    cycles = left // folds - 1
                    heap = [(*(a + b * cycles for a, b in zip(x[:-1], step)), x[-1]) for x in heap]
                    heapq.heapify(heap)
                    taken = [t + cycles for t in taken]
                    left -= cycles * folds
            best = heap[0]
            heapq.heapreplace(heap, (*(a + b for a, b in zip(best[:-1], step)), best[-1]))
            taken[best[-1]] += 1
            left -= 1
        at = 0
        for f, t in enumerate(taken):
            loads[f] = [loads[f][0] + p * t, loads[f][1] + n * t]
            if t:
                yield p, n, f, at, at + t - 1
            at += t


def group_kfold(rows: DataFrame, group: str, k: int, by: Sequence[str] = (), label: str | None = None, seed: int = 0) -> DataFrame:
    """rows with a fold: whole groups, largest first, each to the smallest fold so far; k falls to the number of groups.

    With label, groups with the most positives go first and folds even out in positives, then in rows; groups that are alike are told apart by a seeded hash.
    Only a histogram of group sizes is walked in order, which has at most about the square root of twice the rows as many entries; the groups
    of an entry are numbered over all tasks and take their folds by place.
    """
    from .relational import running_number

    positive = F.sum(F.col(label).cast("long")) if label else F.lit(0).cast("long")
    tie = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(group).cast("string"), F.lit("")))) if label else F.lit("")
    sizes = rows.groupBy(*by, group).agg(F.count("*").alias("_n"), F.sum(F.lit(0)).alias("_zero"), positive.alias("_p") if label else F.max(F.lit(0).cast("long")).alias("_p"))
    sizes = sizes.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_by") if by else F.lit("").alias("_by"), F.col(group).alias("_g"), "_n", F.coalesce("_p", F.lit(0)).alias("_p"), tie.alias("_t"))
    placed = materialised(running_number(materialised(sizes), [F.col("_by"), F.col("_p"), F.col("_n"), F.col("_t"), F.col("_g").asc_nulls_first()], "_place"))
    classes = placed.groupBy("_by", "_p", "_n").agg(F.count("*").alias("_m"), F.min("_place").alias("_first"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", "_n"], ascending=False)
        found = list(deal(zip(pdf["_p"].tolist(), pdf["_n"].tolist(), pdf["_m"].tolist()), int(min(k, pdf["_m"].sum()))))
        out = pd.DataFrame(found, columns=["_p", "_n", "fold", "_from", "_to"])
        out.insert(0, "_by", pdf["_by"].iloc[0])
        return out

    dealt = classes.groupBy("_by").applyInPandas(assign, "_by string, _p bigint, _n bigint, fold int, _from bigint, _to bigint")
    key = ["_by", "_p", "_n"]
    j = placed.join(classes.drop("_m"), key).join(dealt, key).where((F.col("_place") - F.col("_first")).between(F.col("_from"), F.col("_to"))).select("_by", "_g", "fold")
    marked = rows.withColumn("_mine", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""))
    return marked.join(j, (F.col("_mine") == F.col("_by")) & F.col(group).eqNullSafe(F.col("_g")), "left").drop("_mine", "_by", "_g")


def fold_statistics(rows: DataFrame, fold: str, k: int) -> DataFrame:
    """Training copies: each row once for each fold that it is not in, as train_fold."""
    return rows.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("train_fold") != F.col(fold))
