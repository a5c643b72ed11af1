"""Balanced ridge logistic models of many groups at once.

Training rows stay where they are. A Newton step sums each group's gradient and curvature, k and k * k numbers that add up
inside tasks before they are exchanged; the k * k systems are solved one row a group, and the weights go back by a join on the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles
from .state import materialised

#: Scaled values are clipped to this, either way.
CLIP = 10.0


def _of(df: DataFrame, by: Sequence[str], *columns: Column | str) -> DataFrame:
    return df.select(*[F.col(b).alias(f"_of_{b}") for b in by], *columns)


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    return left.join(right, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], how).drop(*[f"_of_{b}" for b in by])


def design(rows: DataFrame, by: Sequence[str], features: Sequence[str], test: str) -> DataFrame:
    """rows with z: 1, each feature minus the training median over the training range from the 5th to the 95th percentile, clipped, and an indicator of each gap.

    Gaps take the median, which is 0 here. A feature without training values is 0, and one without range is not scaled. Statistics are exact, of training rows of the same
    by group, by rank over all tasks.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("_v")) for f in features]))
    long = rows.where(~F.col(test)).select(*by, entries.alias("_e")).select(*by, "_e.*").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = quantiles(long, [*by, "_f"], "_v", [0.05, 0.5, 0.95], ["_low", "_mid", "_high"])
    one = stats.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_f", F.struct("_low", "_mid", "_high").alias("s")))).alias("_stats"))
    j = _joined(rows, _of(one, by, "_stats"), by)

    def gap(f: str) -> Column:
        return F.col(f).isNull() | F.isnan(F.col(f).cast("double"))

    def scaled(f: str) -> Column:
        s = F.try_element_at("_stats", F.lit(f))
        width = F.when(s["_high"] > s["_low"], s["_high"] - s["_low"]).otherwise(1.0)
        z = (F.col(f).cast("double") - s["_mid"]) / width
        return F.when(gap(f) | s.isNull(), 0.0).otherwise(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z)))

    return j.withColumn("z", F.array(F.lit(1.0), *[scaled(f) for f in features], *[gap(f).cast("double") for f in features])).drop("_stats")


def _dot(w: str, z: str) -> Column:
    return F.aggregate(F.zip_with(w, z, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _probability(w: str = "w", z: str = "z") -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _dot(w, z)))))


def fit_weights(train: DataFrame, by: Sequence[str], label: str, size: int, *, c: float = 1.0, tolerance: float = 1e-8, most: int = 60) -> DataFrame:
    """(by, w, gradient_norm, steps) for each group with both classes: minimum of c * balanced log-loss + |w|^2 / 2.

    train has z (size numbers) and the label. gradient_norm is the largest gradient entry at w. All groups step together until the largest step is below the
    tolerance; a step that does not lower a group's loss is halved. Only that one number comes to the driver in a step.
    """
    names_of = dict(zip([f"by{n}" for n in range(len(by))], by))  # own names meanwhile, so that no by column clashes with a number's
    train = train.select(*[F.col(c).alias(b) for b, c in names_of.items()], "z", F.col(label).alias("label"))
    found = _fit(train, list(names_of), size, c, tolerance, most)
    return found.select(*[F.col(b).alias(c) for b, c in names_of.items()], "w", "gradient_norm", "steps")


def _fit(train: DataFrame, by: Sequence[str], size: int, c: float, tolerance: float, most: int) -> DataFrame:
    label = "label"
    counted = train.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("_share")).where("_share > 0 and _share < 1")
    used = _joined(train, _of(counted, by, "_share"), by, "inner")
    weight = F.when(F.col(label) == 1, 0.5 / F.col("_share")).otherwise(0.5 / (1 - F.col("_share"))) * c
    rows = materialised(used.select(*by, "z", F.col(label).cast("double").alias("y"), weight.alias("v")))
    state = counted.select(*by, F.array_repeat(F.lit(0.0), size).alias("w"), F.array_repeat(F.lit(0.0), size).alias("step"), F.lit(float("inf")).alias("loss"), F.lit(float("inf")).alias("moved"), F.lit(0.0).alias("gradient_norm"), F.lit(0).alias("steps"), F.array_repeat(F.lit(0.0), size).alias("trial"))
    kinds = dict(state.dtypes)
    names = state.columns
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    z = lambda i: F.col("z")[i]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w, step, trial = np.array(r.w), np.array(r.step), np.array(r.trial)
                loss = r.sum_l + 0.5 * float(trial @ trial)
                if loss <= r.loss + 1e-12 * abs(loss):  # the trial point holds: step on from it
                    g = np.array(r.sum_g) + trial
                    h = np.zeros((size, size))
                    for (i, j), x in zip(pairs, r.sum_h):
                        h[i, j] = h[j, i] = x
                    step = np.linalg.solve(h + np.eye(size), g)
                    out.append((trial, step, loss, float(np.abs(step).max()), float(np.abs(g).max()), trial - step))
                else:
                    step = step / 2
                    out.append((w, step, r.loss, float(np.abs(step).max()), r.gradient_norm, w - step))
            columns = list(zip(*out)) or [()] * 6
            made = pdf[[*by]].copy()
            for name, values in zip(("w", "step", "loss", "moved", "gradient_norm", "trial"), columns):
                made[name] = list(values)
            made["steps"] = pdf["steps"] + 1
            yield made[names]

    for _ in range(most):
        j = _joined(rows, _of(state, by, "trial"), by, "inner").withColumn("p", _probability("trial"))
        g = F.col("v") * (F.col("p") - F.col("y"))
        h = F.col("v") * F.col("p") * (1 - F.col("p"))
        loss = -F.col("v") * F.when(F.col("y") == 1, F.log("p")).otherwise(F.log1p(-F.col("p")))
        sums = j.withColumns({"g": g, "h": h, "l": loss}).groupBy(*by).agg(F.array(*[F.sum(F.col("g") * z(i)) for i in range(size)]).alias("sum_g"), F.array(*[F.sum(F.col("h") * z(i) * z(k)) for i, k in pairs]).alias("sum_h"), F.sum("l").alias("sum_l"))
        state = materialised(_joined(state, _of(sums, by, "sum_g", "sum_h", "sum_l"), by, "inner").mapInPandas(solve, schema))
        moved = state.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    return state


def fit_logistic(rows: DataFrame, by: Sequence[str], key: str, features: Sequence[str], label: str, test: str, c: float = 1.0) -> DataFrame:
    """(by, key, probability) of the rows whose test flag is set, from a balanced ridge logistic model of the others in the same by group.

    Training medians fill gaps, missing indicators join the features, the 5th to 95th percentile range of training scales them, values are clipped to 10
    either way. NULL where the group's training rows have not both classes.
    """
    z = materialised(design(rows.select(*by, key, *features, F.col(label).alias("_y"), F.col(test).cast("boolean").alias("_test")), by, features, "_test"))
    weights = fit_weights(z.where("not _test"), by, "_y", 1 + 2 * len(features), c=c)
    held = _joined(z.where("_test"), _of(weights, by, "w"), by)
    return held.select(*by, key, F.when(F.col("w").isNotNull(), _probability()).alias("probability"))
