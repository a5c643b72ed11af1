"""Joins with declared cardinality, aggregations, ranking and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_rank, quantiles
from .state import dealt, materialised


class ContractError(ValueError):
    """A declared property of a table does not hold."""


# --- joins -----------------------------------------------------------------------------


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or ContractError if two rows share a key."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ContractError(f"key {list(keys)} is not unique: {twice[0]}")
    return df


def lookup_join(left: DataFrame, dim: DataFrame, keys: Sequence[str], cardinality: str = "many_to_one") -> DataFrame:
    """Left equi-join. The dimension's keys must be unique; for one_to_one the left's too."""
    assert_unique(dim, keys)
    if cardinality == "one_to_one":
        assert_unique(left, keys)
    return left.join(dim, list(keys), "left")


def tag_join(rows: DataFrame, keys: Sequence[str], tags: str, dim: DataFrame, dim_key: str, value: str, out: str) -> DataFrame:
    """rows with the distinct values of the dimension for their tags, in tag order; an empty array for none."""
    each = rows.select(*keys, F.posexplode(tags).alias("_pos", "_tag")).join(dim.select(F.col(dim_key).alias("_tag"), F.col(value).alias("_v")), "_tag")
    lists = each.groupBy(*keys).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_v"))), lambda s: s["_v"])).alias(out))
    return rows.join(lists, list(keys), "left").withColumn(out, F.coalesce(out, F.expr(f"slice(array(cast(null as {dict(dim.dtypes)[value]})), 1, 0)")))


def alias_join(terms: DataFrame, key: Column, overrides: DataFrame, exact: DataFrame) -> DataFrame:
    """terms with target, method and n_targets: an override first, else the exact name, else unmatched. Several targets are kept, not admitted.

    overrides and exact have the columns key and target.
    """
    named = terms.withColumn("_key", key)
    gather = lambda t: t.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_set("target")).alias("t"))
    j = named.join(gather(overrides).withColumnRenamed("t", "_o"), "_key", "left").join(gather(exact).withColumnRenamed("t", "_e"), "_key", "left")
    found = F.coalesce("_o", "_e")
    return j.select(*terms.columns, F.when(F.size(found) == 1, found[0]).alias("target"), F.when(F.col("_o").isNotNull(), "override").when(F.col("_e").isNotNull(), "exact_name").otherwise("unmatched").alias("method"), F.coalesce(F.size(F.coalesce("_o", "_e")), F.lit(0)).alias("n_targets"))


def semi(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted, list(keys), "left_semi")


def anti(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(excluded, list(keys), "left_anti")


def context_inherit(cells: DataFrame, profile: DataFrame, key: str, vintage: str, current: int) -> DataFrame:
    """Each cell with its district's profile (cells without one go), flagged when the profile is older than current."""
    return cells.join(profile, key).withColumn("profile_outdated", F.col(vintage) < current)


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both sources' values by key, whether they agree, and their difference in percent of b."""
    from ..functions.columns import pct_difference

    x, y = F.col(f"{value}_a"), F.col(f"{value}_b")
    j = a.select(*keys, F.col(value).alias(f"{value}_a"), F.lit(True).alias("_in_a")).join(b.select(*keys, F.col(value).alias(f"{value}_b"), F.lit(True).alias("_in_b")), list(keys), "full")
    return j.select(*keys, x, y, F.when(F.col("_in_a").isNull(), "only_b").when(F.col("_in_b").isNull(), "only_a").when(x.eqNullSafe(y), "agree").otherwise("differ").alias("status"), pct_difference(x, y).alias("difference_pct"))


def unlinked(results: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """Results whose lineage key no offer has; must be empty for a valid link."""
    return results.join(offers.select(key).distinct(), key, "left_anti")


def catalog_reconcile(selected: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Availability of each selected key in two catalogues (each with key, x0, y0, x1, y1) and validity of its box."""
    side = lambda t, n: t.groupBy(key).agg(F.max((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))).alias(f"box_{n}"))
    j = selected.join(side(a, "a"), key, "left").join(side(b, "b"), key, "left")
    return j.select(*selected.columns, F.col("box_a").isNotNull().alias("in_a"), F.col("box_b").isNotNull().alias("in_b"), F.coalesce("box_a", "box_b", F.lit(False)).alias("valid_box"), (F.col("box_a").isNotNull() & F.col("box_b").isNotNull()).alias("passed"))


def select_document(rows: DataFrame, keys: Sequence[str], docs: DataFrame, bucket: str, pattern: str, name: str, number: str, pinned: str) -> DataFrame:
    """One document a row: the pinned number if it is given, else the highest number among documents of the row's bucket whose name matches."""
    named = docs.select(F.col(bucket).alias("_b"), F.col(name).alias("_n"), F.col(number).alias("_id"))
    j = rows.select(*keys, bucket, pattern, pinned).join(named, F.col(bucket) == F.col("_b"))
    best = j.where(F.expr(f"_n rlike {pattern}")).groupBy(*keys).agg(F.max("_id").alias("_best"))
    return rows.join(best, list(keys), "left").select(*rows.columns, F.coalesce(F.col(pinned), F.col("_best")).alias("document"))


# --- aggregations -------------------------------------------------------------------------


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def rolling_summary(series: DataFrame, keys: Sequence[str], date: str, value: str, first: str, last: str, order: Sequence[Column]) -> DataFrame:
    """Mean, sum and number of valid days in a fixed date window, one value a day. All-missing groups have NULL mean and sum."""
    days = dedupe(series.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))), [*keys, date], order)
    return days.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.sum(value).alias("sum_value"), F.count(value).alias("valid_days"))


def completeness(summary: DataFrame, key: str, parameter: str, names: Sequence[str], expected: int) -> DataFrame:
    """(key, min_valid_days, complete_pct) over all named parameters; an absent one counts 0."""
    counts = summary.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col(parameter) == n, F.col("valid_days"))), F.lit(0)).alias(f"_{i}") for i, n in enumerate(names)])
    low = F.least(*[F.col(f"_{i}") for i in range(len(names))]) if len(names) > 1 else F.col("_0")
    return counts.select(key, low.alias("min_valid_days"), (100.0 * low / expected).alias("complete_pct"))


def monthly_profile(series: DataFrame, key: str, date: str, value: str, months: Sequence[str]) -> DataFrame:
    """(key, months: array of (month, mean)) over the fixed month list, gaps NULL."""
    means = series.groupBy(key, F.date_format(date, "yyyy-MM").alias("month")).agg(F.avg(value).alias("mean")).where(F.col("month").isin(*months))
    found = means.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("month", "mean"))).alias("m"))
    every = series.select(key).distinct().join(found, key, "left")
    return every.select(key, F.transform(F.array(*map(F.lit, months)), lambda m: F.struct(m.alias("month"), F.col("m")[m].alias("mean"))).alias("months"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).count()


def smoothed_affinity(evidence: DataFrame, everything: DataFrame, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, unit, affinity): (positives + 0.5) / (all + 5) of each unit, over its 95th percentile within by, at most 1."""
    positives = evidence.where(F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.count("*").alias("p"))
    totals = group_counts(everything, unit).withColumnRenamed("count", "t")
    raw = positives.join(totals, unit, "left").select(*by, unit, ((F.col("p") + 0.5) / (F.coalesce("t", F.lit(0)) + 5.0)).alias("raw"))
    scale = raw.groupBy(*by).agg(F.greatest(F.percentile("raw", F.lit(0.95)), F.lit(1e-9)).alias("scale"))
    joined = raw.join(scale, list(by)) if by else raw.crossJoin(F.broadcast(scale))  # one row
    return joined.select(*by, unit, F.least(F.lit(1.0), F.col("raw") / F.col("scale")).alias("affinity"))


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """First-seen distinct values, blind to case, and the sorted set."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, F.lower(value).alias("_low")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("f"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("f")), lambda s: s["v"]).alias("first_seen"), F.sort_array(F.collect_list("_low")).alias("sorted_set"))


def event_rollup(events: DataFrame, keys: Sequence[str], date: str, event_id: str) -> DataFrame:
    """Count, first and last date, sorted distinct years and ids of each key."""
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sort_array(F.collect_set(F.year(date))).alias("years"), F.sort_array(F.collect_list(event_id)).alias("event_ids"))


def sample_rollup(obs: DataFrame, sample: str, parameter: str, value: str, order: str, pivoted: Sequence[str]) -> DataFrame:
    """Per sample: measured and missing counts, distinct parameters, parameters in first-seen order, and the mean of named parameters as columns."""
    first = obs.groupBy(sample, parameter).agg(F.min(order).alias("_o"), F.count(value).alias("_n"), F.count("*").alias("_all"), F.avg(value).alias("_v"))
    return first.groupBy(sample).agg(F.sum("_n").alias("n_measured"), (F.sum("_all") - F.sum("_n")).alias("n_missing"), F.count("*").alias("n_parameters"), F.transform(F.sort_array(F.collect_list(F.struct("_o", parameter))), lambda s: s[parameter]).alias("parameters"), *[F.max(F.when(F.col(parameter) == p, F.col("_v"))).alias(f"mean_{p}") for p in pivoted])


def taxonomy_rollup(rows: DataFrame, tags: str, dim: DataFrame, tag: str, office: str, source: str) -> DataFrame:
    """Per tag of the dimension: rows, distinct offices and sorted source names; absent tags have 0 and an empty array."""
    each = rows.select(F.explode(F.array_distinct(tags)).alias(tag), office, source)
    found = each.groupBy(tag).agg(F.count("*").alias("n_rows"), F.countDistinct(office).alias("n_offices"), F.sort_array(F.collect_set(source)).alias("sources"))
    return dim.select(tag).distinct().join(found, tag, "left").select(tag, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_offices", F.lit(0)).alias("n_offices"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def dimension_totals(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """(dimension, category, is_total, measures): each dimension alone and the grand total under each, in one grouping-sets pass."""
    parts = []
    sets = df.select(*[F.col(d).cast("string").alias(d) for d in dims], *[c.alias(f"_m_{n}") for n, c in measures.items()])
    grouped = sets.groupingSets([[d] for d in dims], *dims).agg(F.grouping_id().alias("_g"), *[F.sum(f"_m_{n}").alias(n) for n in measures])
    for i, d in enumerate(dims):
        own = ((1 << len(dims)) - 1) ^ (1 << (len(dims) - 1 - i))
        mine = grouped.where(F.col("_g") == own).select(F.lit(d).alias("dimension"), F.col(d).alias("category"), F.lit(False).alias("is_total"), *measures)
        total = mine.agg(*[F.sum(n).alias(n) for n in measures]).select(F.lit(d).alias("dimension"), F.lit("TOTAL").alias("category"), F.lit(True).alias("is_total"), *measures)
        parts += [mine, total]
    return reduce(DataFrame.unionByName, parts)


def conditional_counts(samples: DataFrame, keys: Sequence[str], classes: Mapping[str, Column]) -> DataFrame:
    """Number and share of the samples of each class."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n_samples"), *[F.count_if(p).alias(f"n_{n}") for n, p in classes.items()], *[F.avg(F.coalesce(p, F.lit(False)).cast("double")).alias(f"share_{n}") for n, p in classes.items()])


def masked_median(samples: DataFrame, keys: Sequence[str], value: Column, mask: Column, name: str = "median") -> DataFrame:
    """Exact median of the values under the mask; NULL if there are none."""
    return samples.groupBy(*keys).agg(F.percentile(F.when(mask, value), F.lit(0.5)).alias(name))


def multi_season_pool(seasons: Mapping[str, DataFrame], keys: Sequence[str], classes: Mapping[str, Column], value: Column, mask: Column) -> DataFrame:
    pooled = reduce(DataFrame.unionByName, [df.withColumn("season", F.lit(n)) for n, df in seasons.items()])
    counts = conditional_counts(pooled, keys, classes)
    return counts.join(masked_median(pooled, keys, value, mask), list(keys))


def robust_z(df: DataFrame, value: str, name: str = "robust_z") -> DataFrame:
    """(x - median) / (1.4826 MAD) over the table; NULL if the scale is 0. Both medians are picked by rank from counted values."""
    with_middle = df.crossJoin(F.broadcast(quantiles(df, [], value, [0.5], ["_med"])))  # one row
    spread = with_middle.withColumn("_far", F.abs(F.col(value) - F.col("_med")))
    out = with_middle.crossJoin(F.broadcast(quantiles(spread, [], "_far", [0.5], ["_mad"])))  # one row
    return out.withColumn(name, F.when(F.col("_mad") > 0, (F.col(value) - F.col("_med")) / (1.4826 * F.col("_mad")))).drop("_med", "_mad")


def term_frequency(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], separator: str) -> DataFrame:
    """(term, n_rows): distinct terms of a row's fields, counted over rows."""
    terms = F.array_distinct(F.flatten(F.array(*[F.transform(F.split(F.coalesce(F.col(f), F.lit("")), separator), lambda t: F.lower(F.trim(t))) for f in fields])))
    return rows.select(*keys, F.explode(terms).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n_rows"))


def group_invariance(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values, invariant)."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).withColumn("invariant", F.col("n_values") <= 1)


def weighted_average(df: DataFrame, keys: Sequence[str], metric: str, weight: str) -> DataFrame:
    use = F.when(F.col(metric).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg((F.sum(F.col(metric) * F.col(weight)) / F.sum(use)).alias("weighted"))


def threshold_shares(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = (0.95, 0.99, 0.995)) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"), *[F.avg((F.col(value) >= x).cast("double")).alias(f"share_{str(x).replace('.', '_')}") for x in levels])


def site_summary(df: DataFrame, site: str, value: str) -> DataFrame:
    return df.groupBy(site).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def display_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, p02, p98, abs_p98)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    plain = quantiles(long, ["column"], "v", [0.02, 0.98], ["p02", "p98"])
    return plain.join(quantiles(long.withColumn("v", F.abs("v")), ["column"], "v", [0.98], ["abs_p98"]), "column")


def event_list(rows: DataFrame, keys: Sequence[str], events: Mapping[str, tuple[str, str]], name: str = "events") -> DataFrame:
    """(keys, events): each record's events as an array of (event_date, event_type, detail), by date, undated ones last, then by type and detail.

    events: type -> (date column, detail column). An event counts if its detail is there, with a date or without; equal events of a record appear once.
    """
    one = lambda kind, date, detail: F.when(F.col(detail).isNotNull(), F.struct(F.col(date).cast("date").alias("event_date"), F.lit(kind).alias("event_type"), F.col(detail).cast("string").alias("detail")))
    found = rows.select(*keys, F.explode(F.array_compact(F.array(*[one(kind, *columns) for kind, columns in events.items()]))).alias("e"))
    dated = F.struct(F.col("e.event_date").isNull().alias("undated"), "e.event_date", "e.event_type", "e.detail")
    lists = found.groupBy(*keys).agg(F.sort_array(F.collect_set(dated)).alias("_l"))
    plain = F.transform("_l", lambda e: F.struct(e["event_date"].alias("event_date"), e["event_type"].alias("event_type"), e["detail"].alias("detail")))
    every = rows.select(*keys).distinct().join(lists, list(keys), "left")
    return every.select(*keys, F.coalesce(plain, F.array().cast("array<struct<event_date: date, event_type: string, detail: string>>")).alias(name))


# --- ranking -------------------------------------------------------------------------------


def pct_rank_avg(df: DataFrame, part: Sequence[str], by: str, eligible: Column | None = None, name: str = "percentile") -> DataFrame:
    """Average rank over count among eligible rows with a value; NULL for others. Ties share the mean rank."""
    return average_rank(df, part, by, eligible, name)


def top_k_per_row(scores: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str], k: int = 5) -> DataFrame:
    """(key, one aligned array for each field, and its first element): the k best rows of each key."""
    best = scores.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k)
    lists = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", *fields))).alias("_l"))
    return lists.select(key, *[F.col("_l")[f].alias(f"top_{f}s") for f in fields], *[F.col("_l")[0][f].alias(f"top_{f}") for f in fields])


def national_rank(df: DataFrame, keys: Sequence[str], promoted: Column, order: Sequence[Column], name: str = "national_rank") -> DataFrame:
    """1..n over promoted rows, NULL for others."""
    ranked = running_number(df.where(promoted), order, name).select(*keys, name)
    return df.join(ranked, list(keys), "left")


def latest_per_key(events: DataFrame, keys: Sequence[str], date: str, ties: Sequence[Column]) -> DataFrame:
    """The last event of each key; one without a date counts as earliest."""
    return dedupe(events, keys, [F.col(date).desc_nulls_last(), *ties])


def canonical_per_lineage(offers: DataFrame, lineage: str, tranche: str, offer_id: str, name: str, accepted: Column) -> DataFrame:
    """The newest accepted offer of each lineage, with sorted ids and names and the number of events."""
    ok = offers.where(accepted)
    newest = dedupe(ok, [lineage], [F.col(tranche).desc(), F.col(offer_id).desc()])
    lists = ok.groupBy(lineage).agg(F.sort_array(F.collect_set(offer_id)).alias("offer_ids"), F.sort_array(F.collect_set(name)).alias("names"), F.count("*").alias("n_events"))
    return newest.join(lists, lineage)


def best_scene_per_tile(items: DataFrame, tile: str, coverage: str, penalty: str, when: str, item: str) -> DataFrame:
    """Coverage descending, penalty, time and id ascending; tiles whose best coverage is zero go."""
    return dedupe(items.where(F.col(coverage) > 0), [tile], [F.col(coverage).desc(), F.col(penalty), F.col(when), F.col(item)])


def best_pixel_composite(obs: DataFrame, keys: Sequence[str], scene: str, klass: Column, valid_bands: Column, edge: Column, keep: Sequence[str]) -> DataFrame:
    """The observation of highest priority at each sample point; the first scene on ties."""
    priority = klass * 1000000 + valid_bands * 10000 + F.least(edge, F.lit(9999))
    return obs.groupBy(*keys).agg(F.max_by(F.struct(scene, *keep), F.struct(priority.alias("p"), (-F.col(scene)).alias("s"))).alias("b"), F.max(priority).alias("priority")).select(*keys, "b.*", "priority")


def rank_among(scores: DataFrame, group: str, score: str, k: int = 5) -> DataFrame:
    """1 + number of strictly greater scores in the group; NULL scores have no rank."""
    r = F.rank().over(Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last()))
    return scores.withColumn("rank", F.when(F.col(score).isNotNull(), r)).withColumns({"is_top": F.col("rank") == 1, "in_top": F.col("rank") <= k})


def running_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1..n in order without gathering all rows: the order is dealt into ranges, numbered inside each, and each adds the sizes of those before it."""
    split = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    # range boundaries are sampled, so both uses below must see the same ranges
    split = materialised(split.withColumn("_in", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33) + 1))
    sizes = split.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return split.join(before, "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_at", "_in", "_before")


def sequence_ids(df: DataFrame, order: Sequence[Column], prefix: str, width: int = 6, base: str | None = None) -> DataFrame:
    """seq 1..n in order, a zero-padded record id and, with base, a repeat counter of each base key."""
    numbered = running_number(df, order, "seq")
    out = numbered.withColumn("record_id", F.concat(F.lit(prefix), F.lpad(F.col("seq").cast("string"), width, "0")))
    return out.withColumn("repeat", F.row_number().over(Window.partitionBy(base).orderBy(*order))) if base else out


def top_n(df: DataFrame, n: int, by: Sequence[Column]) -> DataFrame:
    return df.orderBy(*by).limit(n)


def order_output(df: DataFrame, keys: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Sort by (column, asc or desc, first or last for NULL)."""
    return df.orderBy(*[getattr(F.col(c), f"{way}_nulls_{nulls}")() for c, way, nulls in keys])


# --- sets ------------------------------------------------------------------------------------


def union_by_name(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_distinct(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, tables).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side a or b, copies counted; empty if the multisets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(key, status): expected keys that are missing, actual keys that are extra. One aggregate over both sides, in partitions of a bounded number of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    side = lambda df, extra: df.select(*keys, F.lit(extra).alias("_extra"))
    both = dealt(side(expected, False).unionByName(side(actual, True)), *keys)
    apart = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.col("_extra")).alias("_null")  # a NULL equals no key
    seen = both.groupBy(*keys, apart).agg(F.min("_extra").alias("_a"), F.max("_extra").alias("_b")).where("_a = _b")
    return seen.select(*keys, F.when(F.col("_a"), "extra").otherwise("missing").alias("status"))


def exact_subset(candidate: DataFrame, base: DataFrame, rule: Column) -> DataFrame:
    """Rows by which the candidate table differs from the filtered base, column for column; empty if it is exact."""
    return symmetric_difference(candidate, base.where(rule).select(*candidate.columns))


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups on both sides; must be empty."""
    return train.select(group).intersect(test.select(group))
