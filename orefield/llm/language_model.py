"""Language-model scores from a log-frequency Bloom filter.

Tokens are words and one end a text. The count of each pair of neighbouring tokens is quantised to
the level q of a geometric scale, and the pair goes into a Bloom filter with each of the levels 1 to q; the level of a
pair is read back by membership probes for levels 1, 2, ... until one misses. The filter is a table of shards by hash of the
pair; a shard holds the pairs of about SHARD_BYTES of training text, so its size does not grow with the table.

    P(w | v) = (level count of vw, at most c(v) and c(w), + MU * P(w)) / (c(v) + MU)
    P(w) = (c(w) + 1) / (N + V + 1)

with exact counts c of single tokens (v is the start before the first word). A level stands for its smallest count, so probabilities of
a context add up to 1 at most, but for false hits.

Workers get by broadcast: the counts of the HEAD most frequent words at most, and the filter if it is
not larger than FILTER_BYTES. With it, rare words are looked up by equi-joins on 64-bit hashes. Beyond that size, texts are dealt into chunks: a chunk
asks each part of the filter for its different pairs and rare words, once each, and scores its texts from the answers. Keys go
as differences of sorted keys, compressed. Both ways give the same scores.

Words are known by 64-bit hashes. Null text counts as empty, which is one end. A null id is a training row. Empty training tables give
counts 0. Rows with equal ids are scored apart. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, key_groups, slices, written

BASE = 1.5
MU = 4.0
HASHES = 4
BITS_PER_EVENT = 8
SHARD_BYTES = 8 << 20
HEAD = 1 << 18
FILTER_BYTES = 96 << 20
_HELD = 3 << 18
_PART = 1 << 20
#: Bytes of text in a chunk, parts of the filter up to which each is one shard, shards in a part at most, pairs that are probed at a time.
_CHUNK = 4 << 20
_PARTS = 512
_SHARDS = 8
_PROBED = 1 << 18
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: The end token: no word holds a space.
_END = xxhash.xxh3_64_intdigest(b" ")
_START = xxhash.xxh3_64_intdigest(b"  ")
#: Constants of the splitmix64 generator.
_STEP, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def levels() -> np.ndarray:
    """Smallest count of each level: the different ceilings of the powers of BASE."""
    return np.unique(np.ceil(BASE ** np.arange(100)).astype(np.int64))


_LEVELS = levels()


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens with each text's end, place of each text's first token and the end)."""
    tokens: list[bytes] = []
    starts = [0]
    for t in texts:
        tokens += t.lower().split()
        tokens.append(b" ")
        starts.append(len(tokens))
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return keys[coded.indices.to_numpy()], np.array(starts)


def contexts(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token."""
    before = np.concatenate([[np.uint64(_START)], keys[:-1]]).astype(np.uint64)
    before[starts[:-1]] = _START
    return before


def pair_hash(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _mix(_mix(before + _STEP) + keys)


class Sums:
    """Counts by 64-bit key of what a task has seen; merges when many entries wait."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(np.unique(keys, return_counts=True))
        self.size += len(self.waiting[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = _summed(np.concatenate([k for k, _ in self.waiting]), np.concatenate([c for _, c in self.waiting])) if self.waiting else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.waiting, self.size = [(keys, counts)] if len(keys) else [], len(keys)
        return keys, counts


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Filter:
    """Shards of a log-frequency Bloom filter, laid end to end."""

    def __init__(self, shards: int, parts: dict[int, bytes]) -> None:
        self.sizes = np.array([len(parts.get(s, b"")) for s in range(shards)], np.int64)
        self.raw = b"".join(parts.get(s, b"") for s in range(shards))  # bytes, which a worker loads without a second copy
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def level(self, pairs: np.ndarray) -> np.ndarray:
        """Level of each pair, 0 if it misses at once: probes for one level after another while they hit."""
        bits, found = np.frombuffer(self.raw, np.uint8), np.zeros(len(pairs), np.int64)
        shard = shard_of(pairs, len(self.sizes))
        alive = np.flatnonzero(self.sizes[shard])
        q = 0
        while len(alive) and q < len(_LEVELS):
            q += 1
            own = shard[alive]
            hit = np.ones(len(alive), bool)
            for bit in probes(pairs[alive], q, self.sizes[own] * 8):
                hit &= (bits[self.offsets[own] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            found[alive] = q
        return found


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers of one type by byte planes, compressed: high bytes of small numbers are all zero."""
    return _ZIP.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_UNZIP.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def short_keys(keys: np.ndarray, shards: int, parts: int) -> np.ndarray:
    """Keys without what their part tells of them; a part holds the shards that leave the same rest by parts."""
    high, n = keys >> np.uint64(32), np.uint64(shards)
    return high % n // np.uint64(parts) * _width(shards) + ((high // n << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)))


def _width(shards: int) -> np.uint64:
    return np.uint64(((1 << 32) // shards + 1) << 32)


def packed_keys(short: np.ndarray) -> bytes:
    """Ascending short keys of one part, as differences."""
    return packed(np.diff(short, prepend=np.zeros(1, np.uint64)))


def unpacked_keys(data: bytes, part: int, shards: int, parts: int) -> np.ndarray:
    short = np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)
    shard, rest = short // _width(shards) * np.uint64(parts) + np.uint64(part), short % _width(shards)
    return (((rest >> np.uint64(32)) * np.uint64(shards) + shard) << np.uint64(32)) | (rest & np.uint64(0xFFFFFFFF))


def probes(pairs: np.ndarray, q: int | np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit places of the event (pair, q), one for each hash."""
    h = _mix(pairs + _STEP * np.asarray(q).astype(np.uint64))
    step = _mix(h) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + step * np.uint64(k)) % np.asarray(bits).astype(np.uint64)).astype(np.int64)


def filter_bits(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Bloom bits of a shard."""
    q = np.searchsorted(_LEVELS, counts, side="right")
    size = int(q.sum()) * BITS_PER_EVENT // 8 + 1
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        for bit in probes(pairs[q >= level], level, size * 8):
            np.bitwise_or.at(bits, bit >> 3, np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
    return bits.tobytes()


class Model:
    """What training leaves: tables of word counts and filter shards in the shared folder, totals, and what fits the broadcast bounds."""

    def __init__(self, words: DataFrame, shards: DataFrame, n_shards: int, head: int, filter_bytes: int) -> None:
        self.words, self.shards, self.n_shards = words, shards, n_shards
        spark = words.sparkSession
        found = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("key") == _signed(_END), F.col("n"))), F.lit(0))).first()
        self.total, self.distinct, self.texts = (int(x) for x in found)
        # words by the power of two below their count: the smallest threshold whose words fit
        sizes = dict(words.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect())  # 64 rows at most
        power = 0
        while sum(n for p, n in sizes.items() if p >= power) > head:
            power += 1
        self.whole_head = power == 0
        table = words.where(F.col("n") >= 1 << power).toArrow()
        keys, counts = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(keys)
        size = shards.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
        self.whole_filter = size <= filter_bytes
        parts = {s: bytes(b) for s, b in shards.collect()} if self.whole_filter else {}
        self.sent = spark.sparkContext.broadcast((keys[order], counts[order], Filter(n_shards, parts)))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def train(docs: DataFrame, *, text_col: str = "text", shard_bytes: int = SHARD_BYTES, head: int = HEAD, filter_bytes: int = FILTER_BYTES) -> Model:
    """Counts over all texts of docs. The number of shards follows the bytes of text."""
    texts = docs.select(F.col(text_col).alias("text"))
    n_shards = max(64, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))

    def by_shards(sums: Sums, kind: int) -> pa.RecordBatch:
        """One row a shard: its sorted keys and their counts."""
        keys, n = sums.merged()
        shard = shard_of(keys, n_shards)
        order = np.argsort(shard, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=n_shards))])
        used = np.flatnonzero(np.diff(ends))
        own = [order[ends[s] : ends[s + 1]] for s in used]
        columns = [pa.array([packed_keys(short_keys(keys[x], n_shards, n_shards)) for x in own], pa.binary()), pa.array([packed(n[x].astype(np.uint32)) for x in own], pa.binary())]
        sums.__init__()
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), kind, np.int32)), *columns], ["shard", "kind", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Sums(), Sums()
        for batch in batches:
            for part in slices(batch, 0, _PART):
                keys, starts = token_keys(as_bytes(part.column(0)))
                words.add(keys)
                pairs.add(pair_hash(contexts(keys, starts), keys))
                for sums, kind in ((words, 0), (pairs, 1)):
                    if sums.size > _HELD:
                        sums.merged()
                        if sums.size > _HELD // 2:
                            yield by_shards(sums, kind)
        yield by_shards(words, 0)
        yield by_shards(pairs, 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cut in key_groups(batches, "shard"):
            for a, b in zip(cut[:-1], cut[1:]):
                sums = []
                for kind in (0, 1):
                    own = [i for i in range(a, b) if rows["kind"][i] == kind]
                    keys = [unpacked_keys(rows["keys"][i], rows["shard"][a], n_shards, n_shards) for i in own]
                    sums.append(_summed(np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *[unpacked(rows["counts"][i], np.uint32) for i in own]])))
                keys, n = sums[0]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n), pa.nulls(len(keys), pa.binary())], ["shard", "key", "n", "bits"])
                yield pa.RecordBatch.from_arrays([pa.array([rows["shard"][a]], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([filter_bits(*sums[1])], pa.binary())], ["shard", "key", "n", "bits"])

    by_shard = texts.mapInArrow(count, "shard int, kind int, keys binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    made = written(by_shard.mapInArrow(fill, "shard int, key bigint, n bigint, bits binary"), "lm-model")
    return Model(made.where("key is not null").select("key", "n"), made.where("bits is not null").select("shard", "bits"), n_shards, head, filter_bytes)


_OPEN = "array<struct<before: bigint, key: bigint, c_before: bigint, c_key: bigint, level: bigint>>"


def token_scores(level: np.ndarray, c_before: np.ndarray, c_key: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the single-token share, log10 of the smoothed probability)."""
    share = (c_key + 1) / (total + distinct + 1)
    seen = np.minimum(np.concatenate([[0], _LEVELS])[level], np.minimum(c_before, c_key))
    return np.log10(share), np.log10((seen + MU * share) / (c_before + MU))


def _head_counts(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    sent, n_texts, whole_head = model.sent, model.texts, model.whole_head

    def counted(keys: np.ndarray) -> np.ndarray:
        """Counts by the head; -1 where the table has to tell."""
        head_keys, head_counts, _ = sent.value
        at = np.minimum(np.searchsorted(head_keys, keys), max(0, len(head_keys) - 1))
        hit = head_keys[at] == keys if len(head_keys) else np.zeros(len(keys), bool)
        out = np.where(hit, head_counts[at] if len(head_keys) else 0, 0 if whole_head else -1)
        return np.where(keys == _START, n_texts, out)

    return counted


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    total, distinct, whole_head = model.total, model.distinct, model.whole_head
    sent, counted = model.sent, _head_counts(model)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    train_tokens = F.lit(total).cast("long").alias("train_tokens")
    if not model.whole_filter:
        return _by_chunks(plain, kind, model).select("id", "n_tokens", "n_known", train_tokens, "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = sent.value[2]
        for batch in batches:
            for part in slices(batch, 1, _PART):
                keys, starts = token_keys(as_bytes(part.column(1)))
                before = contexts(keys, starts)
                pairs, at = np.unique(pair_hash(before, keys), return_inverse=True)
                level = bloom.level(pairs)[at]
                words, place = np.unique(np.concatenate([before, keys]), return_inverse=True)
                c = counted(words)[place]
                c_before, c_key = c[: len(keys)], c[len(keys) :]
                told = (c_before >= 0) & (c_key >= 0)
                base, full = token_scores(np.where(told, level, 0), np.where(told, c_before, 0), np.where(told, c_key, 0), total, distinct)
                sums = [np.add.reduceat(np.where(told, x, 0), starts[:-1]) for x in (base, full, c_key > 0)]
                left = np.flatnonzero(~told)
                doc = np.searchsorted(starts, left, side="right") - 1
                items = pa.StructArray.from_arrays([pa.array(x[left].view(np.int64)) for x in (before, keys)] + [pa.array(np.asarray(x[left], np.int64)) for x in (c_before, c_key, level)], ["before", "key", "c_before", "c_key", "level"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(starts)), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends), items)], ["id", "n_tokens", "n_known", "base_score", "score", "open"])

    done = plain.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, open {_OPEN}")
    if whole_head:
        return done.select("id", "n_tokens", "n_known", train_tokens, "base_score", "score")
    done = written(done.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rest = done.where(F.size("open") > 0).select("row", F.explode("open").alias("o")).select("row", "o.*")
    for side in ("before", "key"):
        counts = model.words.select(F.col("key").alias("_k"), F.col("n").alias("_n"))
        known = rest.where(F.col(f"c_{side}") >= 0)
        asked = rest.where(F.col(f"c_{side}") < 0).join(counts, F.col(side) == F.col("_k"), "left")
        rest = known.unionByName(asked.withColumn(f"c_{side}", F.coalesce("_n", F.lit(0))).drop("_k", "_n"))
    share = (F.col("c_key") + 1) / F.lit(float(total + distinct + 1))
    scale = F.array(*[F.lit(int(x)) for x in [0, *_LEVELS]])
    seen = F.least(F.get(scale, F.col("level").cast("int")), F.col("c_before"), F.col("c_key"))
    sums = rest.groupBy("row").agg(F.count_if(F.col("c_key") > 0).alias("k"), F.sum(F.log10(share)).alias("b"), F.sum(F.log10((seen + MU * share) / (F.col("c_before") + MU))).alias("s"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return done.drop("open").join(sums, "row", "left").select("id", "n_tokens", plus("n_known", "k"), train_tokens, plus("base_score", "b"), plus("score", "s"))


def _by_chunks(plain: DataFrame, kind: str, model: Model) -> DataFrame:
    """score() without the filter at hand: chunks of texts ask the parts of the filter, and read their texts again beside the answers."""
    total, distinct, n_shards, counted = model.total, model.distinct, model.n_shards, _head_counts(model)
    n_chunks = (plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _CHUNK + 1
    n_parts = -(-n_shards // min(_SHARDS, 1 + n_shards // _PARTS))
    plain = plain.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks)))

    def asked(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Keys, their contexts and each text's start; the chunk's words, their counts and places; its pairs and their places."""
        keys, starts = token_keys(as_bytes(table["text"]))
        before = contexts(keys, starts)
        words, place = np.unique(np.concatenate([before, keys]), return_inverse=True)
        return keys, starts, words, counted(words), place, *np.unique(pair_hash(before, keys), return_inverse=True)

    def by_parts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by part and short key, the short keys, and where each part starts and ends."""
        part, short = shard_of(hashes, n_shards) % n_parts, short_keys(hashes, n_shards, n_parts)
        return np.lexsort((short, part)), short, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, _, words, c, _, pairs, _ = asked(table)
        sides = [by_parts(x) for x in (words[c < 0], pairs)]
        used = np.flatnonzero(sum(np.diff(ends) for _, _, ends in sides))
        columns = [pa.array([packed_keys(short[order[ends[p] : ends[p + 1]]]) for p in used], pa.binary()) for order, short, ends in sides]
        return pa.table([pa.array([key[0].as_py()] * len(used), pa.int64()), pa.array(used, pa.int32()), *columns], ["chunk", "part", "words", "pairs"])

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.filter(pc.is_valid(right["key"]))
        known, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(known)
        known, n = np.append(known[order], np.uint64(0)), np.append(n[order], 0)
        bits = right.filter(pc.is_valid(right["bits"]))
        bloom = Filter(n_shards, dict(zip(bits["shard"].to_pylist(), bits["bits"].to_pylist())))
        made, waiting, size = [], [], 0
        for i, row in enumerate(zip(left["chunk"].to_pylist(), left["words"].to_pylist(), left["pairs"].to_pylist())):
            waiting.append((row[0], *[unpacked_keys(x, key[0].as_py(), n_shards, n_parts) for x in row[1:]]))
            size += len(waiting[-1][2])
            if size < _PROBED and i + 1 < left.num_rows:
                continue
            words, pairs = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
            at = np.searchsorted(known[:-1], words)
            found = (np.where(known[at] == words, n[at], 0), bloom.level(pairs).astype(np.uint8))
            cuts = [np.cumsum([len(w[k]) for w in waiting])[:-1] for k in (1, 2)]
            columns = [pa.array([packed(x) for x in np.split(f, cut)], pa.binary()) for f, cut in zip(found, cuts)]
            made.append(pa.RecordBatch.from_arrays([pa.array([w[0] for w in waiting], pa.int64()), pa.array([key[0].as_py()] * len(waiting), pa.int32()), *columns], ["chunk", "part", "counts", "levels"]))
            waiting, size = [], 0
        return pa.Table.from_batches(made, pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("levels", pa.binary())]))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, starts, words, c, place, pairs, at = asked(left)
        right = right.sort_by("part")
        told = lambda name, kind: np.concatenate([np.empty(0, kind), *[unpacked(x, kind) for x in right[name].to_pylist()]])
        level = np.zeros(len(pairs), np.int64)
        level[by_parts(pairs)[0]] = told("levels", np.uint8)
        rare = np.flatnonzero(c < 0)
        c[rare[by_parts(words[rare])[0]]] = told("counts", np.int64)
        c_before, c_key = c[place[: len(keys)]], c[place[len(keys) :]]
        base, full = token_scores(level[at], c_before, c_key, total, distinct)
        sums = [np.add.reduceat(x, starts[:-1]) for x in ((c_key > 0).astype(np.int64), base, full)]
        return pa.table([left["id"], pa.array(np.diff(starts)), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    own = lambda shard: (shard % n_parts).cast("int").alias("part")
    words = model.words.select(own(F.pmod(F.shiftrightunsigned("key", 32), F.lit(n_shards))), "key", "n", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("bits"))
    shards = model.shards.select(own(F.col("shard")), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), "shard", "bits")
    parts = shards if model.whole_head else words.unionByName(shards)
    questions = plain.groupBy("chunk").applyInArrow(ask, "chunk bigint, part int, words binary, pairs binary")
    answers = questions.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(answer, "chunk bigint, part int, counts binary, levels binary")
    answers = written(answers, "lm-answers")
    return plain.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
