"""Scores per cell and target, and their evaluation. All tables are long: one row for each (cell, target), fold or replicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, distance_decay, support_weight
from .folds import fold_statistics, group_kfold  # noqa: F401
from .logistic import fit_logistic
from .relational import pct_rank_avg, smoothed_affinity
from .spatial import count_places, search
from .state import materialised, stored

#: Weights of affinity, decay and density with enough evidence, of decay and density without, and the evidence that is enough.
WEIGHTS = (0.50, 0.35, 0.15)
SPARSE_WEIGHTS = (0.80, 0.20)
ENOUGH = 5
#: Modulus and factors of the integer generator that orders samples and draws groups; SQL can repeat it.
MODULUS = 2147483647
FACTOR_ID, FACTOR_SEED = 48271, 69621


def integer_hash(id_: Column, seed: Column | int) -> Column:
    """A reproducible pseudo-random number below MODULUS, in whole numbers only."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    mixed = (id_.cast("long") % MODULUS * FACTOR_ID + seed.cast("long") % 30000 * FACTOR_SEED + 12345) % MODULUS
    return (mixed * FACTOR_ID + 11) % MODULUS


#: Targets that a cell row may carry as one array; rows of a small side that may be broadcast.
_LISTED = 10_000
_SENT = 1 << 19


def _counted(df: DataFrame) -> DataFrame:
    """A stored df with the hint that its number of rows allows."""
    return df.hint("broadcast" if df.count() <= _SENT else "merge")


def _cells_by_targets(cells: DataFrame, targets: DataFrame, part: Sequence[str]) -> DataFrame:
    """Every cell with every target (of its part). A counted, short list of targets rides on each cell and is unpacked there, so cells do not move; a
    longer one is joined as Spark sees fit.
    """
    targets = materialised(targets)
    own = [c for c in targets.columns if c not in part]
    if targets.count() > _LISTED:
        return cells.join(targets, list(part)) if part else cells.crossJoin(targets)
    lists = targets.groupBy(*part).agg(F.collect_list(F.struct(*own)).alias("_targets"))
    listed = cells.join(F.broadcast(lists), list(part)) if part else cells.crossJoin(F.broadcast(lists))  # at most _LISTED targets in all
    return listed.withColumn("_t", F.explode("_targets")).select(*cells.columns, *[F.col("_t")[c].alias(c) for c in own])


def score_cells(cells: DataFrame, evidence: DataFrame, targets: DataFrame, *, cell: str = "cell_id", unit: str = "unit_id", target: str = "material_id", site: str = "site_id", density_km: float = 100.0, part: Sequence[str] = (), ranked: bool = True) -> DataFrame:
    """(part, cell, target, n_evidence, nearest_km, density, affinity, score, percentile, support_level); without ranked no percentile.

    cells: (part, cell, lat, lon, unit); evidence: (part, target, site, lat, lon, unit); targets: (target). part columns (a
    fold, say) keep scores of different training sets apart: every statistic is taken within them. Targets without
    evidence give no row. Distances and densities are found for the different places, and each cell reads the list of its place.
    """
    by = [*part, target]
    n = evidence.groupBy(*by).agg(F.count("*").alias("n_evidence"))
    places = stored(cells.groupBy(*part, "lat", "lon").agg(F.count("*").alias("_cells")))
    grid = _cells_by_targets(places, n.join(targets.select(target).distinct(), target, "left_semi"), part)
    at = [*by, "lat", "lon"]
    known = grid.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*at)
    near = search(known, evidence, 1, ref_id=site, by=by, name="_best").select(*at, F.get("_best", F.lit(0))["km"].alias("nearest_km"))
    dense = count_places(known, evidence, density_km, by=by, name="density")
    base = grid.join(near.hint("merge"), at, "left").join(dense.hint("merge"), at, "left").withColumn("density", F.coalesce("density", F.lit(0)))
    base = stored(base.select(*at, "_cells", "n_evidence", "nearest_km", "density"))
    scale = base.groupBy(*by).agg(F.greatest(F.percentile("density", F.lit(0.95), F.col("_cells")), F.lit(1.0)).alias("_scale"))
    affinity = smoothed_affinity(evidence, cells.dropDuplicates([cell]) if part else cells, unit, by)
    lists = base.groupBy(*[F.col(c).alias(f"_at_{c}") for c in (*part, "lat", "lon")]).agg(F.collect_list(F.struct(target, "n_evidence", "nearest_km", "density")).alias("_list"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*part, "lat", "lon")])
    each = cells.select(*part, cell, unit, "lat", "lon").join(lists.hint("merge"), same).select(*part, cell, unit, F.inline("_list"))
    small = [_counted(stored(t)) for t in (scale, affinity)]  # else all scores would be shuffled to meet them
    j = each.join(small[0], by).join(small[1], [*by, unit], "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0)))
    decay, dense = distance_decay("nearest_km"), clip(F.col("density") / F.col("_scale"))
    full = WEIGHTS[0] * F.col("affinity") + WEIGHTS[1] * decay + WEIGHTS[2] * dense
    sparse = SPARSE_WEIGHTS[0] * decay + SPARSE_WEIGHTS[1] * dense
    enough = F.col("n_evidence") >= ENOUGH
    level = F.when(F.col("n_evidence") >= 20, "high").when(enough, "medium").otherwise("low")
    scored = j.withColumns({"score": clip(F.when(enough, full).otherwise(sparse) * support_weight("n_evidence")), "support_level": level})
    scored = scored.select(*by, cell, "n_evidence", "nearest_km", "density", "affinity", "score", "support_level")
    if not ranked:
        return scored
    out = pct_rank_avg(stored(scored), by, "score", enough & (F.col("nearest_km") > 10))
    return out.select(*by, cell, "n_evidence", "nearest_km", "density", "affinity", "score", "percentile", "support_level")


def sample_background(pool: DataFrame, key: str, seed: int, n: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """n rows of each by group without replacement, the same ones every time: the first in the order of the integer hash. n may be a column."""
    order = Window.partitionBy(*by).orderBy(integer_hash(F.col(key), seed), key)
    return pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def background_size(positives: Column, least: int = 500, factor: int = 20) -> Column:
    return F.greatest(F.lit(least), positives * factor)


# --- metrics --------------------------------------------------------------------------------


def roc_auc(df: DataFrame, by: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """(by, auc): probability that a positive outranks a negative, ties a half; NULL without one of them."""
    w = F.col(weight) if weight else F.lit(1)
    ties = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    sums = ties.withColumn("b", F.coalesce(below, F.lit(0))).groupBy(*by).agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return sums.select(*by, F.try_divide("u", F.col("np") * F.col("nn")).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """(by, average_precision): sum over distinct thresholds of the recall gained times the precision there."""
    ties = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label)).alias("p"), F.count("*").alias("c"))
    down = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = ties.withColumns({"tp": F.sum("p").over(down), "m": F.sum("c").over(down), "all": F.sum("p").over(Window.partitionBy(*by))})
    return steps.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("m")), F.max("all")).alias("average_precision"))


def recall_at_background_top(df: DataFrame, by: Sequence[str], score: str, label: str, p: float = 0.95) -> DataFrame:
    """(by, recall): share of positives at or above the background's percentile."""
    cut = df.where(F.col(label) == 0).groupBy(*by).agg(F.percentile(score, F.lit(p)).alias("_cut"))
    return df.where(F.col(label) == 1).join(cut, list(by)).groupBy(*by).agg(F.avg((F.col(score) >= F.col("_cut")).cast("double")).alias("recall"))


def brier(df: DataFrame, by: Sequence[str], probability: str, label: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(probability) - F.col(label), 2)).alias("brier"))


def group_wins(df: DataFrame, by: Sequence[str], group: str, score: str, label: str) -> DataFrame:
    """(by, gp, gn, wins): for each positive group and background group the pairs of rows that the positive one wins, ties a half.

    A background group is sorted with the positives of its by group, once for all replicates: an AUC of weighted groups is a sum over pairs of groups then.
    """
    rows = df.where(F.col(score).isNotNull())
    negative = rows.where(F.col(label) == 0).groupBy(*by, F.col(group).alias("gn"), F.col(score).alias("s")).agg(F.count("*").alias("n"))
    positive = rows.where(F.col(label) == 1).groupBy(*by, F.col(group).alias("gp"), F.col(score).alias("s")).agg(F.count("*").alias("p"))
    each = positive.join(negative.select(*by, "gn").distinct(), list(by))
    both = negative.select(*by, "gn", F.lit(None).cast(positive.schema["gp"].dataType).alias("gp"), "s", "n", F.lit(0).alias("p")).unionByName(each.select(*by, "gn", "gp", "s", F.lit(0).alias("n"), "p"))
    w = Window.partitionBy(*by, "gn").orderBy("s")
    below, same = F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.sum("n").over(Window.partitionBy(*by, "gn", "s"))
    counted = both.withColumns({"upto": below, "same": same}).where("p > 0")
    return counted.groupBy(*by, "gp", "gn").agg(F.sum(F.col("p") * (F.col("upto") - F.col("same") / 2)).alias("wins"))


def weighted_aucs(df: DataFrame, by: Sequence[str], group: str, score: str, label: str, draws: DataFrame, share: Sequence[str]) -> DataFrame:
    """(by, rep, auc) when groups count as often as draws (share, group, label, rep, times) says; share: the by columns that draws has.

    If pairs of groups are not more than rows, by pairs of groups; else by weighted rows. Both are exact.
    """
    df = stored(df.select(*by, group, F.col(score).alias(score), label))
    sizes = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(group).alias("_g"), label).agg(F.count("*").alias("_c"))
    sizes = materialised(sizes)
    most = sizes.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"), F.sum("_c").alias("c")).agg(F.sum(F.col("p") * F.col("n")), F.sum("c")).first()
    if (most[0] or 0) > (most[1] or 0):
        return roc_auc(df.join(draws, [*share, group, label]), [*by, "rep"], score, label, "times")
    times = lambda y, name, t: draws.where(F.col(label) == y).select(*share, F.col(group).alias(name), "rep", F.col("times").alias(t))
    wins = group_wins(df, by, group, score, label)
    won = wins.join(times(1, "gp", "tp"), [*share, "gp"]).join(times(0, "gn", "tn"), [*share, "rep", "gn"]).groupBy(*by, "rep").agg(F.sum(F.col("wins") * F.col("tp") * F.col("tn")).alias("u"))
    total = lambda y, name: sizes.where(F.col(label) == y).join(times(y, "_g", "t"), [*share, "_g"]).groupBy(*by, "rep").agg(F.sum(F.col("_c") * F.col("t")).alias(name))
    return won.join(total(1, "np"), [*by, "rep"]).join(total(0, "nn"), [*by, "rep"]).select(*by, "rep", F.try_divide("u", F.col("np") * F.col("nn")).alias("auc"))


#: Parts into which a range of scores is cut, and how often (numbers of ranges are 64 bits); rows times replicates that may be unpacked.
_BINS = 64
_ROUNDS = 9
_UNPACKED = 1 << 22


def weighted_cuts(background: DataFrame, by: Sequence[str], group: str, score: str, draws: DataFrame, level: float = 0.95) -> DataFrame:
    """(by, rep, _cut): the percentile of each replicate's weighted background rows, as if each row stood there times over.

    Ranges of scores are cut into _BINS parts again and again: counts of groups tell in which part a replicate's two ranks lie, and only rows of such parts
    stay, until few are left to unpack (or none of the ranges gets narrower).
    """
    held = background.where(F.col(score).isNotNull()).select(*by, group, F.col(score).cast("double").alias("s"), F.lit(0).cast("long").alias("_bin"))
    counts = stored(held.groupBy(*by, group, "_bin").agg(F.count("*").alias("_c"), F.min("s").alias("_lo"), F.max("s").alias("_hi")))
    reps = counts.join(draws, [*by, group]).groupBy(*by, "rep").agg(F.sum(F.col("_c") * F.col("times")).alias("_w"))
    at = F.lit(float(level)) * (F.col("_w") - 1)
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("_high"), F.floor(at).alias("_at")), F.struct(F.lit(1).alias("_high"), F.ceil(at).alias("_at"))))
    targets = stored(reps.select(*by, "rep", (at - F.floor(at)).alias("_part"), ranks.alias("r"), F.lit(0).cast("long").alias("_bin")).select(*by, "rep", "_part", "r.*", "_bin"))
    spans = lambda c: c.groupBy(*by, "_bin").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_c").alias("_n"))
    bins, last = stored(spans(counts)), None
    for _ in range(_ROUNDS):
        cost = targets.select(*by, "rep", "_bin").distinct().join(bins, [*by, "_bin"]).agg(F.sum("_n")).first()[0] or 0
        if cost <= _UNPACKED or (last is not None and cost > last * 0.9):
            break
        last = cost
        width = F.col("_hi") - F.col("_lo")
        sub = F.when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("s") - F.col("_lo")) / width * _BINS), F.lit(_BINS - 1))).otherwise(0)
        cut = held.join(_counted(bins), [*by, "_bin"]).select(*by, group, "s", (F.col("_bin") * _BINS + sub).alias("_bin"))
        counts = stored(cut.groupBy(*by, group, "_bin").agg(F.count("*").alias("_c"), F.min("s").alias("_lo"), F.max("s").alias("_hi")))
        was = F.expr(f"_bin div {_BINS}").alias("_was")
        wanted = draws.join(targets.select(*by, "rep", F.col("_bin").alias("_was")).distinct().hint("merge"), [*by, "rep"])
        weights = wanted.join(_counted(counts.select(*by, group, was, "_bin", "_c")), [*by, group, "_was"]).groupBy(*by, "rep", "_was", "_bin").agg(F.sum(F.col("_c") * F.col("times")).alias("_w"))
        upto = F.sum("_w").over(Window.partitionBy(*by, "rep", "_was").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        found = targets.withColumnRenamed("_bin", "_was").join(weights.withColumn("_u", upto), [*by, "rep", "_was"]).where((F.col("_at") < F.col("_u")) & (F.col("_at") >= F.col("_u") - F.col("_w")))
        targets = stored(found.select(*by, "rep", "_part", "_high", (F.col("_at") - (F.col("_u") - F.col("_w"))).alias("_at"), "_bin"))
        bins = stored(spans(counts.join(targets.select(*by, "_bin").distinct(), [*by, "_bin"], "left_semi")))
        held = stored(cut.join(_counted(bins.select(*by, "_bin")), [*by, "_bin"], "left_semi"))
    rows = stored(held.groupBy(*by, "_bin", group, "s").agg(F.count("*").alias("_c")))
    wanted = draws.join(targets.select(*by, "rep", "_bin").distinct().hint("merge"), [*by, "rep"])
    ties = wanted.join(_counted(rows), [*by, "_bin", group]).groupBy(*by, "rep", "_bin", "s").agg(F.sum(F.col("_c") * F.col("times")).alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy(*by, "rep", "_bin").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    held_at = ties.withColumn("_u", upto).join(targets, [*by, "rep", "_bin"]).where(F.col("_u") > F.col("_at"))
    side = lambda high: F.min(F.when(F.col("_high") == high, F.col("s")))
    picked = held_at.groupBy(*by, "rep").agg(side(0).alias("_a"), side(1).alias("_b"), F.first("_part").alias("_part"))
    return picked.select(*by, "rep", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("_cut"))


def _weighted_recall(positive: DataFrame, by: Sequence[str], group: str, score: str, draws: DataFrame, cuts: DataFrame) -> DataFrame:
    """(by, rep, recall): share of each replicate's weighted positive rows at or above its cut; rows without a score do not count.

    Rows are counted by group and by how many of the different cuts they reach, so they do not meet the replicates.
    """
    cuts = stored(cuts)
    steps = cuts.groupBy(*by).agg(F.array_sort(F.collect_set("_cut")).alias("_cuts"))  # as many as replicates at most
    rows = positive.where(F.col(score).isNotNull()).groupBy(*by, group, score).agg(F.count("*").alias("_c")).join(steps, list(by))
    reached = rows.withColumn("_reached", F.size(F.filter("_cuts", lambda c: c <= F.col(score)))).groupBy(*by, group, "_reached").agg(F.sum("_c").alias("_c"))
    lists = reached.groupBy(*by, group).agg(F.collect_list(F.struct("_reached", "_c")).alias("_list"), F.sum("_c").alias("_all"))
    place = cuts.join(steps, list(by)).select(*by, "rep", F.array_position("_cuts", F.col("_cut")).cast("int").alias("_place"))
    hits = F.aggregate(F.filter("_list", lambda x: x["_reached"] >= F.col("_place")), F.lit(0).cast("long"), lambda a, x: a + x["_c"])
    each = draws.join(lists, [*by, group]).join(place, [*by, "rep"])
    return each.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("times") * hits), F.sum(F.col("times") * F.col("_all"))).alias("recall"))


def group_bootstrap(df: DataFrame, by: Sequence[str], group: str, score: str, label: str, reps: int, seed: int) -> DataFrame:
    """(by, auc_low, auc_high, recall_low, recall_high): 2.5th and 97.5th percentile of the AUC and of the recall at the background's top when whole groups are drawn with replacement, positive and background ones apart.

    A replicate draws as many groups as there are; the multiplicity of a group weights its rows, also in the background's percentile.
    """
    groups = df.groupBy(*by, label, group).agg(F.first(F.lit(1)).alias("_1")).drop("_1")
    w = Window.partitionBy(*by, label)
    placed = groups.withColumns({"g": F.row_number().over(w.orderBy(group)) - 1, "m": F.count("*").over(w)})
    draws = placed.select(*by, label, "m", F.col("g").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = draws.withColumn("g", integer_hash(F.col("draw") * 7919 + F.col("rep") * 104729 + F.col(label), seed) % F.col("m")).groupBy(*by, label, "rep", "g").agg(F.count("*").alias("times"))
    weights = materialised(drawn.join(placed, [*by, label, "g"]).select(*by, label, group, "rep", "times"))
    one = [*by, "rep"]
    of = lambda y: weights.where(F.col(label) == y).drop(label)
    cuts = weighted_cuts(df.where(F.col(label) == 0), by, group, score, of(0))
    recall = _weighted_recall(df.where(F.col(label) == 1), by, group, score, of(1), cuts)
    each = weighted_aucs(df, by, group, score, label, weights, by).join(recall, one, "left")
    return each.groupBy(*by).agg(*[F.percentile(m, F.lit(p)).alias(f"{m}_{side}") for m in ("auc", "recall") for side, p in (("low", 0.025), ("high", 0.975))])


def group_draws(df: DataFrame, by: Sequence[str], group: str, label: str, reps: int, seed: int, least_positive: int = 3) -> DataFrame:
    """(by, group, rep, times): how often a replicate draws a group, with replacement, positive groups (with any positive row) and background groups apart, as many as there are.

    By groups with fewer than least_positive positive groups or no background group have no draws. The draws depend on the groups' order only, so
    any table with the same groups can share them.
    """
    groups = df.groupBy(*by, group).agg(F.max((F.col(label) == 1).cast("int")).alias("_kind"))
    w = Window.partitionBy(*by, "_kind")
    placed = groups.withColumns({"_g": F.row_number().over(w.orderBy(group)) - 1, "_m": F.count("*").over(w)})
    whole = Window.partitionBy(*by)
    placed = placed.withColumns({"_pos": F.sum("_kind").over(whole), "_all": F.count("*").over(whole)}).where((F.col("_pos") >= least_positive) & (F.col("_all") > F.col("_pos")))
    placed = materialised(placed)
    draws = placed.select(*by, "_kind", "_m", F.col("_g").alias("_draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = draws.withColumn("_g", integer_hash(F.col("_draw") * 7919 + F.col("rep") * 104729 + F.col("_kind"), seed) % F.col("_m")).groupBy(*by, "_kind", "rep", "_g").agg(F.count("*").alias("times"))
    return drawn.join(placed, [*by, "_kind", "_g"]).select(*by, group, "rep", "times")


def paired_bootstrap(df: DataFrame, by: Sequence[str], group: str, base: str, extended: str, label: str, reps: int = 500, seed: int = 7) -> DataFrame:
    """(by, delta_low, delta_high, valid): 2.5th and 97.5th percentile of the gain in AUC of extended over base when whole groups are drawn, and the replicates with both classes.

    Both arms share each replicate's draws. NULL and 0 where group_draws() has none.
    """
    draws = group_draws(df, by, group, label, reps, seed)
    both_labels = materialised(draws.withColumn("_y", F.explode(F.array(F.lit(0), F.lit(1)))))  # a drawn group brings all its rows
    arms = F.explode(F.array(F.struct(F.lit(0).alias("arm"), F.col(base).alias("s")), F.struct(F.lit(1).alias("arm"), F.col(extended).alias("s"))))
    long = df.where(F.col(base).isNotNull() & F.col(extended).isNotNull()).select(*by, group, F.col(label).cast("int").alias("_y"), arms.alias("a")).select(*by, group, "_y", "a.*")
    auc = weighted_aucs(long, [*by, "arm"], group, "s", "_y", both_labels, by)
    deltas = auc.groupBy(*by, "rep").agg((F.max(F.when(F.col("arm") == 1, F.col("auc"))) - F.max(F.when(F.col("arm") == 0, F.col("auc")))).alias("_d"))
    found = deltas.groupBy(*by).agg(F.percentile("_d", F.lit(0.025)).alias("delta_low"), F.percentile("_d", F.lit(0.975)).alias("delta_high"), F.count("_d").alias("valid"))
    every = df.select(*by).distinct()
    return every.join(found, list(by), "left").fillna(0, ["valid"])


# --- models --------------------------------------------------------------------------------------


def fill_from_training(train: DataFrame, test: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """test with missing features filled by the training rows' medians (of the same by group); a feature without any training value stays NULL."""
    medians = train.groupBy(*by).agg(*[F.percentile(f, F.lit(0.5)).alias(f"_m_{f}") for f in features])
    joined = test.join(medians, list(by), "left") if by else test.crossJoin(F.broadcast(medians))  # one row
    return joined.withColumns({f: F.coalesce(F.col(f), F.col(f"_m_{f}")) for f in features}).drop(*[f"_m_{f}" for f in features])


def out_of_fold(rows: DataFrame, target: str, key: str, fold: str, k: int, label: str, arms: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """(target, key, kept columns, fold, y, one probability for each arm): every row predicted by the models of the other folds, all arms on the same rows and folds."""
    marked = materialised(rows.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_held", F.col(fold) == F.col("test_fold")))
    out = rows.select(target, key, *keep, F.col(fold).alias("test_fold"), F.col(label).cast("int").alias("y"))
    for arm, features in arms.items():
        out = out.join(fit_logistic(marked, [target, "test_fold"], key, features, label, "_held").withColumnRenamed("probability", arm), [target, key, "test_fold"], "left")
    return materialised(out)


def paired_ablation(rows: DataFrame, target: str, key: str, fold: str, k: int, label: str, arms: Mapping[str, Sequence[str]], *, group: str, reps: int = 500, seed: int = 7) -> DataFrame:
    """(target, metrics of both arms, their deltas, delta_low, delta_high, valid, folds gained and lost): out-of-fold metrics of the arms base and extended on the same rows and folds.

    The interval is that of paired_bootstrap() over groups. Rows that an arm could not predict count in neither.
    """
    base, extended = arms
    oof = out_of_fold(rows, target, key, fold, k, label, arms, [group]).where(F.col(base).isNotNull() & F.col(extended).isNotNull())
    long = oof.select(target, "test_fold", "y", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("probability")) for a in arms])).alias("a")).select(target, "test_fold", "y", "a.*")
    by = [target, "arm"]
    whole = roc_auc(long, by, "probability", "y").join(average_precision(long, by, "probability", "y"), by).join(recall_at_background_top(long, by, "probability", "y"), by).join(brier(long, by, "probability", "y"), by)
    names = ("auc", "average_precision", "recall", "brier")
    side = lambda df, a, on, cols: df.where(F.col("arm") == a).select(*on, *[F.col(c).alias(f"{a}_{c}") for c in cols])
    both = side(whole, base, [target], names).join(side(whole, extended, [target], names), target)
    folds = roc_auc(long, [*by, "test_fold"], "probability", "y")
    pairs = side(folds, base, [target, "test_fold"], ["auc"]).join(side(folds, extended, [target, "test_fold"], ["auc"]), [target, "test_fold"])
    d = F.col(f"{extended}_auc") - F.col(f"{base}_auc")
    counts = pairs.groupBy(target).agg(F.count_if(d > 1e-12).alias("folds_gained"), F.count_if(d < -1e-12).alias("folds_lost"))
    interval = paired_bootstrap(oof, [target], group, base, extended, "y", reps, seed)
    return both.join(counts, target).join(interval, target).select(target, *[F.col(f"{a}_{n}") for a in arms for n in names], *[(F.col(f"{extended}_{n}") - F.col(f"{base}_{n}")).alias(f"delta_{n}") for n in names], "delta_low", "delta_high", "valid", "folds_gained", "folds_lost")


def admission_decision(positives: Column, groups: Column, complete: Column, distance: Column, valid_rate: Column, auc: Column, delta: Column, low: Column, recall: Column, base_recall: Column, *, least_positives: int = 10, least_groups: int = 5, purge_km: float = 50.0) -> Column:
    """struct(decision, reason) from fixed gates on support, folds, purge distance, coverage, AUC, gain, uncertainty and recall."""
    gate = (positives >= least_positives) & (groups >= least_groups) & complete & (distance >= purge_km - 1e-6) & (valid_rate >= 0.80) & (auc >= 0.60) & (delta >= 0.02) & (low > 0) & (recall >= base_recall)
    pick = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return F.when(delta.isNull(), pick("not_evaluated", "no_paired_metric")).when(gate, pick("passed", "all_gates_pass")).when(delta < 0, pick("degraded", "paired_auc_decreased")).otherwise(pick("inconclusive", "one_or_more_gates_failed"))


def transfer_observations(blocks: DataFrame, block: str, target: str, cell: str, scores: DataFrame, *, outside_km: float = 25.0) -> DataFrame:
    """One row for each block and target: the cell's score, percentile, nearest distance, rank among targets, domain and gate booleans.

    blocks: (block, cell, targets array); scores: (cell, target, score, percentile, nearest_km).
    """
    from .relational import rank_among

    each = blocks.select(block, cell, F.explode(F.array_distinct("targets")).alias(target))
    wanted = scores.join(each.select(cell).distinct(), cell, "left_semi")  # ranks are taken within a cell, so only the blocks' cells are needed
    ranked = rank_among(wanted, cell, "score")
    j = each.join(ranked, [cell, target], "left")
    flags = F.array_compact(F.array(F.when(F.col("score").isNull(), F.lit("no_score")), F.when(F.col("nearest_km") <= outside_km, F.lit("inside_known_evidence"))))
    return j.withColumns({"outside_known": F.col("nearest_km") > outside_km, "within_domain": F.col("nearest_km") <= 250, "passes_score_gate": F.col("score") >= 0.5, "flags": flags})


def transfer_metrics(observations: DataFrame, background: DataFrame, target: str, group: str, *, least: int = 5, reps: int = 500, seed: int = 7) -> DataFrame:
    """Per target: blocks, AUC, average precision, recall at the background's top, bootstrap intervals over groups, percentile shares and gate status, for blocks outside known evidence.

    Both tables hold (target, group, score, percentile); observations also outside_known.
    """
    from .relational import threshold_shares

    pos = observations.where("outside_known and score is not null").select(target, group, "score", "percentile", F.lit(1).alias("label"))
    pos = stored(pos)  # used by every metric
    both = stored(pos.drop("percentile").unionByName(background.select(target, group, "score", F.lit(0).alias("label"))))
    by = [target]
    n = pos.groupBy(target).agg(F.count("*").alias("n_blocks"))
    out = n
    for part in (roc_auc(both, by, "score", "label"), average_precision(both, by, "score", "label"), recall_at_background_top(both, by, "score", "label"), group_bootstrap(both, by, group, "score", "label", reps, seed), threshold_shares(pos, by, "percentile")):
        out = out.join(part, by, "left")
    status = F.when(F.col("n_blocks") < least, "too_few_blocks").when((F.col("auc") >= 0.6) & (F.col("auc_low") > 0.5), "passed").otherwise("not_passed")
    return out.withColumn("status", status)


def score_parity(published: DataFrame, recomputed: DataFrame, cell: str, arrays: Mapping[str, str], target: str, long_target: str, digits: int = 4) -> DataFrame:
    """(kind, compared, mismatches): published aligned arrays against a long recomputed table. arrays: published array -> recomputed column; target names the array of targets, long_target the recomputed table's column."""
    zipped = published.select(cell, F.explode(F.arrays_zip(target, *arrays)).alias("z"))
    long = zipped.select(cell, F.col(f"z.{target}").alias("_t"), *[F.col(f"z.{a}").alias(f"_p_{a}") for a in arrays])
    j = long.join(recomputed.withColumnRenamed(long_target, "_t"), [cell, "_t"], "left")
    one = j.agg(*[F.struct(F.lit(c).alias("kind"), F.count("*").alias("compared"), F.count_if(~F.round(F.col(f"_p_{a}"), digits).eqNullSafe(F.round(F.col(c), digits))).alias("mismatches")).alias(a) for a, c in arrays.items()])
    return one.select(F.explode(F.array(*arrays)).alias("r")).select("r.*")


def metric_parity(current: DataFrame, reference: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float) -> DataFrame:
    """(metric, max_difference, missing_differs, passed) of two result tables."""
    j = current.select(*keys, *[F.col(m).alias(f"_a_{m}") for m in metrics]).join(reference.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics]), list(keys), "full")
    one = j.agg(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.max(F.abs(F.col(f"_a_{m}") - F.col(f"_b_{m}"))), F.lit(0.0)).alias("max_difference"), F.count_if(F.col(f"_a_{m}").isNull() != F.col(f"_b_{m}").isNull()).alias("missing_differs")).alias(m) for m in metrics])
    return one.select(F.explode(F.array(*metrics)).alias("r")).select("r.*").withColumn("passed", (F.col("max_difference") <= tolerance) & (F.col("missing_differs") == 0))

