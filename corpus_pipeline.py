"""From raw documents to packed training bins: five stages, each over all that the one before kept.

Stages: quality (documents the classifier rejects go), simhash (one document, the one with the smallest id, of each group
of near duplicates stays), decontaminate (documents with a benchmark passage go), secrets (found
secrets are replaced by a mark) and pack (bins of a fixed number of words). All but the last return
the columns of documents. The near-duplicate stage links documents whose sets of distinct five-word shingles have a
similarity of at least 0.8: candidates share a rare shingle, the SimHash operator's pivot tables discard the far ones, and
every link is verified on the sets. A row with the id and the text of another is its copy; rows with one id and different texts are judged apart.
Null and empty texts are copies of one another. Extra columns stay as they are.

Documents with a null id are kept by the near-duplicate stage, all of them: it cannot name them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.llm import decontaminate, packing, quality, secrets, set_join
from orefield.llm._common import beside, shared_folder, table, written

KEEP_SCORE = 0.7
SHINGLE, SIMILARITY = 5, 0.8
SALTS = 16


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs has it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.weights:  # a class without labelled rows: nothing tells documents apart, so none is rejected
        return docs
    return beside(docs, ["_score"], lambda d: quality.score(d, model, score_col="_score").where(F.col("_score") >= KEEP_SCORE))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(set_join.similar_sets(docs, shingle=SHINGLE, similarity=SIMILARITY), "near-duplicates")
    first = found.where("id is not null").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("component", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = found.where("id is not null").withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int"))  # a large group is spread over tasks
    mark, nameless = free_name(docs, "_mark"), free_name(docs, "_nameless")
    later = rows.join(first, ["component", "salt"]).where(F.struct("id", "mark") != F.col("first")).select(F.col("id").alias("doc_id"), F.col("mark").alias(mark)).distinct()
    marked = docs.withColumns({mark: F.xxhash64("doc_id", "text"), nameless: F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())})
    return marked.join(later, ["doc_id", mark], "left_anti").dropDuplicates(["doc_id", "text", nameless]).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, decontaminate.load_items(table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs)
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_words"), "source", F.col("bin").alias("bin_id"), "position", F.col("start").alias("start_word"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("simhash", keep_first_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", redact_secrets),
    ("pack", pack),
]

#: The stages hold trained models and hashes that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
