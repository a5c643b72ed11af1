"""Checks, manifests, dictionaries and registers, each a table of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_text, multi_pattern_tags, row_hash
from .relational import ContractError


def check_suite(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(name, observed, expected, passed, all_passed): each rule is an aggregate and what it must equal; one pass over df."""
    one = df.agg(*[F.struct(F.lit(n).alias("name"), o.cast("string").alias("observed"), e.cast("string").alias("expected"), o.cast("string").eqNullSafe(e.cast("string")).alias("passed")).alias(f"_{i}") for i, (n, (o, e)) in enumerate(rules.items())])
    rows = F.array(*[F.col(f"_{i}") for i in range(len(rules))])
    return one.select(F.explode(rows).alias("r"), F.forall(rows, lambda r: r["passed"]).alias("all_passed")).select("r.*", "all_passed")


def check_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_rows, n_blank, n_duplicate): rows, rows with a blank key part, and rows beyond the first of their key."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "" for k in keys])
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(blank).alias("b"))
    return each.agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_blank"), F.sum(F.col("n") - 1).alias("n_duplicate"))


def check_foreign_key(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(key, n): child keys that no parent has."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")
    return lost.groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, columns: Sequence[str], ranged: Sequence[str] = ()) -> DataFrame:
    """(column, rate, low, high): share of rows with a value, and the range of numeric columns."""
    low = lambda c, f: f(c).cast("double") if c in ranged else F.lit(None).cast("double")
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNotNull().cast("double")).alias("rate"), low(c, F.min).alias("low"), low(c, F.max).alias("high")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def schema_hash(columns: Sequence[str]) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(list(columns), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def assert_schema(df: DataFrame, contract: str) -> DataFrame:
    """df, or ContractError if its ordered column list does not hash to the contract."""
    if schema_hash(df.columns) != contract:
        raise ContractError(f"columns differ from the contract: {df.columns}")
    return df


def subtotal_check(df: DataFrame, identities: Sequence[tuple[Sequence[str], str]], total: str, least: float = 2.0, share: float = 2e-5) -> DataFrame:
    """df with max_error and passed: each identity's parts must add up to its sum within max(least, share x total)."""
    errors = [F.abs(F.col(s) - reduce(lambda a, b: a + b, [F.col(p) for p in parts])) for parts, s in identities]
    worst = F.greatest(*errors) if len(errors) > 1 else errors[0]
    return df.withColumn("max_error", worst).withColumn("passed", F.col("max_error") <= F.greatest(F.lit(least), F.abs(F.col(total)) * share))


def contiguous(df: DataFrame, column: str) -> DataFrame:
    """(low, high, n, n_distinct, contiguous): are the values exactly 1..n?"""
    one = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n"), F.countDistinct(column).alias("n_distinct"))
    return one.withColumn("contiguous", (F.col("n") == 0) | ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("n_distinct") == F.col("n"))))


def content_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, fingerprint): an order-free hash of the selected columns; equal multisets of rows have equal fingerprints."""
    h = row_hash(*[F.col(c) for c in columns])
    part = lambda i: F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("n_rows"), F.concat_ws("-", *[part(i).cast("string") for i in (1, 9, 17, 25)]).alias("fingerprint"))


def build_manifest(tables: Mapping[str, DataFrame], contracts: Mapping[str, Mapping]) -> DataFrame:
    """One row a table: key, uniqueness, rows, columns, schema hash, role, grain."""
    parts = []
    for name, df in tables.items():
        c = contracts[name]
        found = check_key(df, c["key"])
        parts.append(found.select(F.lit(name).alias("table"), F.lit(",".join(c["key"])).alias("primary_key"), ((F.col("n_duplicate") == 0) & (F.col("n_blank") == 0)).alias("key_valid"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(schema_hash(df.columns)).alias("schema_sha256"), F.lit(c.get("role", "")).alias("role"), F.lit(c.get("grain", "")).alias("grain")))
    return reduce(DataFrame.union, parts)


def profile_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, data_type, n_rows, n_missing, n_blank) of every column, from one pass over each table."""
    parts = []
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        blank = lambda c: F.count_if(F.trim(F.col(c)) == "") if kinds[c] == "string" else F.lit(0).cast("long")
        one = df.agg(F.count("*").alias("_n"), *[F.struct(F.count(F.col(c)).alias("filled"), blank(c).alias("blank")).alias(c) for c in df.columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("data_type"), F.col(c)["filled"].alias("filled"), F.col(c)["blank"].alias("blank")) for c in df.columns]))
        parts.append(one.select("_n", each.alias("r")).select(F.lit(name).alias("table"), "r.column", "r.data_type", F.col("_n").alias("n_rows"), (F.col("_n") - F.col("r.filled")).alias("n_missing"), F.col("r.blank").alias("n_blank")))
    return reduce(DataFrame.union, parts)


def build_dictionary(columns: DataFrame, own: DataFrame, aliases: DataFrame, shared: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(table, column, definition, basis): the table's own definition, else an alias's, else the shared one, else a rule by the column's name.

    columns (table, column and any more, which stay, such as those of profile_columns()); own (table, column, definition); aliases (column, target); shared (column, definition).
    """
    more = [c for c in columns.columns if c not in ("table", "column")]
    o = own.withColumnRenamed("definition", "_own")
    a = aliases.join(shared.select(F.col("column").alias("target"), F.col("definition").alias("_alias")), "target").select("column", "_alias")
    s = shared.withColumnRenamed("definition", "_shared")
    j = columns.join(o, ["table", "column"], "left").join(a, "column", "left").join(s, "column", "left")
    rule = F.coalesce(*[F.when(F.col("column").rlike(p), F.lit(d)) for p, d in rules.items()], F.lit(None).cast("string"))
    basis = F.when(F.col("_own").isNotNull(), "own").when(F.col("_alias").isNotNull(), "alias").when(F.col("_shared").isNotNull(), "shared").when(rule.isNotNull(), "rule").otherwise("missing")
    return j.select("table", "column", F.coalesce("_own", "_alias", "_shared", rule).alias("definition"), basis.alias("basis"), *more)


def gap_register(sources: DataFrame, key: str, limitation: str, categories: Mapping[str, Sequence[str]], lineage: DataFrame) -> DataFrame:
    """One gap for each source with a limitation: its categories by pattern and the tables that use the source. lineage: (key, tables array)."""
    gaps = sources.where(clean_text(limitation).isNotNull()).select(F.col(key), clean_text(limitation).alias("gap"), multi_pattern_tags(limitation, categories).alias("categories"))
    return gaps.join(lineage, key, "left").withColumn("categories", F.when(F.size("categories") == 0, F.array(F.lit("other"))).otherwise(F.col("categories")))


def lineage_index(tables: Mapping[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """(key, tables): which tables mention each source id in their array column."""
    parts = [df.select(F.explode(column).alias(key)).distinct().withColumn("table", F.lit(name)) for name, (df, column) in tables.items()]
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.sort_array(F.collect_set("table")).alias("tables"))


def guardrail_check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations, passed): rows for which the rule does not hold (NULL counts as a violation)."""
    one = df.agg(*[F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(p, F.lit(False))).alias("violations")).alias(f"_{i}") for i, (n, p) in enumerate(rules.items())])
    return one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(rules))])).alias("r")).select("r.*").withColumn("passed", F.col("violations") == 0)


def feature_collection_parity(table: DataFrame, features: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(kind, n): keys on one side only, and rows that differ in each compared column."""
    a = table.select(key, *[F.col(c).cast("string").alias(f"_a_{c}") for c in compared], F.lit(1).alias("_ta"))
    b = features.select(key, *[F.col(c).cast("string").alias(f"_b_{c}") for c in compared], F.lit(1).alias("_tb"))
    both = F.col("_ta").isNotNull() & F.col("_tb").isNotNull()
    kinds = {"only_table": F.col("_tb").isNull(), "only_features": F.col("_ta").isNull()} | {f"differs_{c}": both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in compared}
    one = a.join(b, key, "full").agg(*[F.count_if(p).alias(n) for n, p in kinds.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in kinds])).alias("r")).select("r.*")


def completion_audit(requirements: Mapping[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(requirement, evidence, passed): each requirement is an aggregate of its own table and a test on that aggregate, named value."""
    parts = [df.agg(value.alias("value")).select(F.lit(name).alias("requirement"), F.col("value").cast("string").alias("evidence"), F.coalesce(test, F.lit(False)).alias("passed")) for name, (df, value, test) in requirements.items()]
    return reduce(DataFrame.union, parts)


def required_text_check(docs: DataFrame, key: str, text: str, strings: Sequence[str]) -> DataFrame:
    """(key, missing): required strings that a document lacks; complete documents give no row."""
    lacking = F.array_compact(F.array(*[F.when(~F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(s)), F.lit(s)) for s in strings]))
    return docs.select(key, F.explode(lacking).alias("missing"))
