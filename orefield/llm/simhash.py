"""SimHash near-duplicates by pivot distance tables.

Fingerprint: a bit is 1 where more than half of the shingle hashes have it set. Documents with
equal fingerprints collapse to one node before anything is compared. Candidate pairs meet in
pigeonhole buckets (two fingerprints that differ in at most r of b > r bit blocks agree on at
least b - r of them). Inside a bucket each member's table of Hamming distances to the reference
fingerprints (pivots) is compared first: by the triangle inequality, a pair whose largest
coordinate difference exceeds the radius cannot link and is discarded. Survivors are verified
bit by bit. A bucket gives a spanning forest of its links, never all its pairs, so a dense group of m
copies costs m - 1 rows.

Near duplicates by the similarity of shingle sets (set_join.py) use long signatures of the sets in the same way: candidates
that share a rare shingle are discarded by the pivot tables, and what is left is verified on the whole sets.

Nulls and empty texts have no shingle: their fingerprint is zero and they link as any other.
A row with a null id has a fingerprint
but no component, which is null, and joins no others. Repeated rows keep one output row each. Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Batches, as_bytes, components, key_groups, written

PIVOTS = 16
#: 64-bit words of the long signatures of shingle sets, and the bits in which two of them may differ at a similarity of 0.8.
SET_WORDS, SET_RADIUS, SMALL_SET_RADIUS, SMALL_SET = 8, 128, 150, 50
#: Members of a bucket that are compared with one another at a time.
BUCKET_BLOCK = 1024
_CHUNK = 4096
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, repeat(42))), np.uint8).reshape(-1, 8)


def _widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """words x 64 pseudo-random bits for each 64-bit hash; one word is the hash itself."""
    if words == 1:
        return hashes
    h = hashes.copy().view(">u8").ravel().astype(np.uint64)
    out = np.empty((len(h), words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            x = h + np.uint64((_MIX[0] * (j + 1)) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, j] = x ^ (x >> np.uint64(31))
    return out.view(np.uint8).reshape(len(h), words * 8)


def signature(text: bytes, shingle: int = 3, words: int = 1) -> bytes:
    """The fingerprint of one text, 8 x words bytes, most significant bit first."""
    hashes = _hashes(text, shingle)
    total = np.zeros(words * 64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        total += np.unpackbits(_widened(hashes[i : i + _CHUNK], words), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """(id, signature binary) for each row."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([signature(t, shingle, words) for t in as_bytes(b.column(1))], pa.binary())], names=["id", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, signature binary")


def pivot_bits(n_bytes: int, count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random bytes, count x n_bytes."""
    raw = b"".join(xxhash.xxh64_digest(f"{i}", seed=7) for i in range(count * n_bytes // 8))
    return np.frombuffer(raw, np.uint8).reshape(count, n_bytes)


def pivot_table(signatures: np.ndarray) -> np.ndarray:
    """Hamming distances of each signature (rows of bytes) to each pivot."""
    pivots = pivot_bits(signatures.shape[1])
    return np.stack([np.bitwise_count(signatures ^ p).sum(axis=1, dtype=np.uint16) for p in pivots], axis=1)


def block_keys(signatures: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """Pigeonhole keys of 64-bit fingerprints: one for each choice of blocks - radius equal blocks."""
    value = signatures.copy().view(">u8")[:, 0].astype(np.uint64)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return np.stack([_mixed(value & np.uint64(sum(masks[i] for i in chosen)), n) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))], axis=1)


def _mixed(value: np.ndarray, table: int) -> np.ndarray:
    """A bijection of 64 bits for each table, so equal keys mean equal values of one table (but for chance)."""
    with np.errstate(over="ignore"):
        x = value + np.uint64((_MIX[0] * (table + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX[1])
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def bucket_links(nodes: np.ndarray, signatures: np.ndarray, table: np.ndarray, radius: int, sizes: np.ndarray | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of one bucket.

    With sizes (of sets), those whose ratio is below similarity do not link, and the radius is the one for sets of that size.
    """
    left = np.arange(len(nodes))
    links: list[tuple[int, int]] = []
    table = table.astype(np.int16)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = left
            if sizes is not None:
                near = left[(sizes[left] >= similarity * sizes[at]) & (sizes[left] * similarity <= sizes[at])]
                radius = SMALL_SET_RADIUS if similarity * sizes[at] < SMALL_SET else SET_RADIUS
            for axis in range(table.shape[1]):
                near = near[np.abs(table[near, axis] - table[at, axis]) <= radius]
                if not len(near):
                    break
            if len(near):
                near = near[np.bitwise_count(signatures[near] ^ signatures[at]).sum(axis=1, dtype=np.int32) <= radius]
            if len(near):
                links += [(int(nodes[at]), int(nodes[i])) for i in near]
                frontier += list(near)
                left = left[~np.isin(left, near)]
    return links


def _in_buckets(radius: int):
    def run(batches: Batches) -> Batches:
        for rows, cuts in key_groups(batches, "key"):
            src: list[int] = []
            dst: list[int] = []
            for g in np.flatnonzero(np.diff(cuts) > 1):
                part = slice(cuts[g], cuts[g + 1])
                sig = np.frombuffer(b"".join(rows["signature"][part]), np.uint8).reshape(cuts[g + 1] - cuts[g], -1)
                dist = np.frombuffer(b"".join(rows["pivots"][part]), np.uint16).reshape(len(sig), -1)
                for a, b in bucket_links(rows["node"][part], sig, dist, radius):
                    src.append(a)
                    dst.append(b)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def near_links(nodes: DataFrame, *, radius: int, blocks: int) -> DataFrame:
    """Links (src, dst) that join the nodes (node, signature) at radius or fewer differing bits: exact, by pigeonhole buckets of 64-bit signatures."""

    def keyed(batches: Batches) -> Batches:
        for b in batches:
            raw = b.column(1).to_pylist()
            node = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(raw), 2048):
                sig = np.frombuffer(b"".join(raw[i : i + 2048]), np.uint8).reshape(-1, 8)
                keys, dist = block_keys(sig, radius, blocks), pivot_table(sig)
                times = keys.shape[1]
                columns = [pa.array(keys.ravel()), pa.array(np.repeat(node[i : i + 2048], times)), pa.array([x for x in raw[i : i + 2048] for _ in range(times)], pa.binary()), pa.array([y for x in dist for y in [x.tobytes()] * times], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "signature", "pivots"])

    keys = nodes.select("node", "signature").mapInArrow(keyed, "key long, node long, signature binary, pivots binary")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_in_buckets(radius), "src long, dst long").distinct()


def set_signature(hashes: np.ndarray, words: int = SET_WORDS) -> bytes:
    """The long signature of a set of 64-bit shingle hashes."""
    total = np.zeros(words * 64, np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), _CHUNK):
        total += np.unpackbits(_widened(raw[i : i + _CHUNK], words), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(raw)).tobytes()


def with_pivots(nodes: DataFrame) -> DataFrame:
    """nodes (node, signature) with the distances of each signature to the pivots."""

    def measured(batches: Batches) -> Batches:
        for b in batches:
            raw = b.column(1).to_pylist()
            if raw:
                dist = pivot_table(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), pa.array([x.tobytes() for x in dist], pa.binary())], names=["node", "signature", "pivots"])

    return nodes.select("node", "signature").mapInArrow(measured, "node long, signature binary, pivots binary")


def _table(column: np.ndarray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def near_in_buckets(entries: DataFrame, similarity: float) -> DataFrame:
    """A spanning forest (src, dst) of the near pairs of signatures in each bucket.

    entries: key, members (rows of the key), node, size (of its set), signature, pivots. A bucket of more than BUCKET_BLOCK
    members is split, and each block meets each other one in a task of its own.
    """

    def run(batches: Batches) -> Batches:
        for rows, cuts in key_groups(batches, "block"):
            links: set[tuple[int, int]] = set()
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    links.update(bucket_links(rows["node"][a:b], _table(rows["signature"][a:b], np.uint64), _table(rows["pivots"][a:b], np.uint16), SET_RADIUS, rows["size"][a:b], similarity))
            if links:
                found = np.array(list(links), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["src", "dst"])

    parts = F.ceil(F.col("members") / BUCKET_BLOCK).cast("int")
    split = entries.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    block = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("block")
    blocks = split.select(block, "node", "size", "signature", "pivots").repartition("block").sortWithinPartitions("block", "node")
    return blocks.mapInArrow(run, "src long, dst long").distinct()


def near_sets(i: int, others: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, table: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Which of others are near the set i, nearest first, and in how many bits they differ."""
    others = others[(sizes[others] >= similarity * sizes[i]) & (sizes[others] * similarity <= sizes[i])]
    radius = SMALL_SET_RADIUS if similarity * sizes[i] < SMALL_SET else SET_RADIUS
    others = others[np.abs(table[others].astype(np.int32) - table[i]).max(axis=1, initial=0) <= radius]
    bits = np.bitwise_count(signatures[others] ^ signatures[i]).sum(axis=1, dtype=np.int32)
    order = np.argsort(bits, kind="stable")[: int((bits <= radius).sum())]
    return others[order].tolist(), bits[order].tolist()


def near_pairs(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs (src, dst) of nodes whose long signatures (node, size, signature, pivots) are near: first by pivots, then bit by bit."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            sizes, *tables = (b.column(i).to_pylist() for i in range(2, 7))
            x, y, one, other = (_table(t, k) for t, k in zip(tables, (np.uint64, np.uint64, np.uint16, np.uint16)))
            radius = np.where(np.array(sizes) < SMALL_SET, SMALL_SET_RADIUS, SET_RADIUS)
            keep = np.abs(one.astype(np.int32) - other).max(axis=1) <= radius
            keep[keep] = np.bitwise_count(x[keep] ^ y[keep]).sum(axis=1, dtype=np.int32) <= radius[keep]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(keep))

    one, other = (signatures.select(F.col("node").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("size", "signature", "pivots"))) for n in ("src", "dst"))
    joined = pairs.join(one, "src").join(other, "dst")
    return joined.select("src", "dst", F.least("src_size", "dst_size"), "src_signature", "dst_signature", "src_pivots", "dst_pivots").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, radius: int = 2, blocks: int = 5) -> DataFrame:
    """(id, signature, component): component is the smallest id reachable through links, itself included."""
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, words=words), "simhash")
    nodes = written(marked.groupBy("signature").agg(F.min("id").alias("node")), "simhash-nodes")
    links = near_links(nodes.where("node is not null"), radius=radius, blocks=blocks)
    parts = components(links, "simhash")
    named = nodes.join(parts, "node", "left").select("signature", F.coalesce("component", "node").alias("component"))
    return marked.join(named, "signature").select("id", "signature", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
