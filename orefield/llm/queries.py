"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, flac, html_text, language_model, merkle, packing, quality, secrets, simhash, suffix_dedup, token_count, token_store
from ._common import table, with_text_columns, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2, blocks=5)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("signature")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    automata = decontaminate.load_items(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), automata)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Media hardly shrink, copies of them do.
_MEDIA = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = written(flac.stored(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media"), "op6-media", **_MEDIA)

    def measured(files: list[bytes]) -> list[pa.Array]:
        blocks = flac.decode(files)
        payloads = [b"".join(p for _, p in own) for own in blocks]
        tails = [zlib.crc32(flac.seek_tail(own, 64)) for own in blocks]
        return [pa.array([len(p) for p in payloads], pa.int64()), pa.array(payloads, pa.binary()), pa.array(tails, pa.int64()), pa.array([flac.features(p) for p in payloads], pa.string())]

    read = with_text_columns(held, "media", "payload_bytes bigint, payload binary, tail_crc32 bigint, feature string", measured, 2 << 20)
    return read.select("doc_id", "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, dictionary = token_store.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_store.read(blocks, dictionary, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_words"), "source", "cluster", F.col("bin").alias("bin_id"), "position", F.col("start").alias("start_word"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda key: F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))
    model = language_model.train(docs.where(~held_out("doc_id")))
    return language_model.score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": F.translate("text", _UPPER, _UPPER.lower())}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return folded.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_quality, op3_secrets, op4_decontaminate, op5_html_text, op6_flac, op7_token_store, op8_packing, op9_suffix_dedup, op10_token_count, op11_divergence, op12_language_model, op13_merkle)}


def _secrets_sql() -> str:
    """The same spans by splitting each text at the matches."""
    parts, arrays = [], []
    for n, rule in enumerate(secrets.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(
            f"string_split_regex(t, '{p}') AS p{n}, regexp_extract_all(t, '{p}', 0) AS h{n}, regexp_extract_all(t, '{p}', {rule.group}) AS g{n}"
        )
        start = f"CAST(list_sum(list_transform(p{n}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h{n}[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
        arrays.append(
            f"list_transform(list_filter(range(1, len(h{n}) + 1), lambda i: length(g{n}[i]) >= {rule.least}), lambda i: {{'s': {start}, 'r': {n}, 'k': '{rule.kind}', 'e': {start} + length(h{n}[i])}})"
        )
    joined = "array_to_string(list_transform(list_sort({}), lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    both = " || ".join(f"a{n}" for n in range(len(secrets.RULES)))
    base = " || ".join(f"a{n}" for n in range(len(secrets.BASE)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(parts)} FROM d),
a AS (SELECT doc_id, {', '.join(f'{x} AS a{n}' for n, x in enumerate(arrays))} FROM m)
SELECT doc_id, CAST(len(a0) AS BIGINT) AS n_assign, CAST(len(a1) AS BIGINT) AS n_access, CAST(len(a2) AS BIGINT) AS n_hex,
       sha256({joined.format(base)}) AS base_sha256, {joined.format(both)} AS spans
FROM a"""


#: The benchmark contract in SQL. An item or document is its list of words; windows meet by equality of
#: the joined words, at word positions.
_DECONTAMINATE_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM grams JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

#: Every step of the audit on whole tables; 128-bit integers hold what the operator's long division avoids.
_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
g AS (SELECT lang, source, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, coalesce(g.n, 0) AS n, v FROM groups JOIN v USING (lang) LEFT JOIN g USING (lang, source)),
gt AS (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(gt.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(gt.n, 0) + 1)::HUGEINT // (total.n + v) AS HUGEINT) AS p FROM total JOIN kept USING (lang) LEFT JOIN gt USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
l AS (SELECT lang, term, 1 + CAST(1000000000 * (kept.n + 1)::HUGEINT // (v.n + v) AS HUGEINT) AS q FROM kept JOIN v USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

#: A source's tree is a list of lists of digests; crc32 runs over each bit of the id's digits.
_MERKLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, crc, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [-2 - ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x < -1 THEN xor(a, -2 - x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) AS crc FROM documents)),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL SELECT source, level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM up WHERE len(nodes) > 1),
sub AS (SELECT source, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM up WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT placed.source, pos, level, array_to_string(nodes[pos // (16 ** level)::BIGINT // 16 * 16 + 1:pos // (16 ** level)::BIGINT], '') AS lo, array_to_string(nodes[pos // (16 ** level)::BIGINT + 2:pos // (16 ** level)::BIGINT // 16 * 16 + 16], '') AS hi
  FROM placed JOIN up ON placed.source IS NOT DISTINCT FROM up.source WHERE len(nodes) > 1
  UNION ALL SELECT placed.source, pos, 1000 + level, array_to_string(nodes[place // (16 ** level)::BIGINT // 16 * 16 + 1:place // (16 ** level)::BIGINT], ''), array_to_string(nodes[place // (16 ** level)::BIGINT + 2:place // (16 ** level)::BIGINT // 16 * 16 + 16], '')
  FROM placed JOIN sub ON placed.source IS NOT DISTINCT FROM sub.source, top WHERE len(nodes) > 1),
paths AS (SELECT source, pos, list({'a': lo, 'b': hi} ORDER BY level) AS path FROM steps GROUP BY ALL),
folded AS (SELECT placed.*, coalesce(path, []) AS path, list_reduce(list_prepend({'a': coalesce(altered, leaf), 'b': ''}, coalesce(path, [])), lambda x, y: {'a': sha256(y.a || x.a || y.b), 'b': ''}).a AS folded_root FROM placed LEFT JOIN paths ON placed.source IS NOT DISTINCT FROM paths.source AND placed.pos = paths.pos)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) AS proof_sha256, folded_root, folded_root = (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS verified
FROM folded JOIN sub ON folded.source IS NOT DISTINCT FROM sub.source"""

ORACLE_SQL: dict[str, str] = {"op3_secrets": _secrets_sql(), "op4_decontaminate": _DECONTAMINATE_SQL, "op11_divergence": _DIVERGENCE_SQL, "op13_merkle": _MERKLE_SQL}
