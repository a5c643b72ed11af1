"""Near duplicates by the exact similarity of shingle sets: a prefix-filter join in Spark.

The similarity of two texts is the share of common ones among their distinct shingles. Texts with equal
sets are one node. With all shingles in one fixed order, two sets of a similarity of at least p / q share one of the first
n - ceil(n p / q) + 1 shingles of each; the join on these prefixes, with bounds on sizes and on the number of shared
prefix shingles, gives every such pair. Of these candidates the SimHash operator's pivot tables discard those whose long
signatures are too far apart for that similarity (a radius of six deviations, wider for small sets: it loses one link in 10**8 at most), and each pair left is verified on its whole sets.

  1. Each bucket (nodes that share a prefix shingle) links its members to two of them; verified links give groups.
  2. In buckets with several groups the members' signatures are compared; a spanning forest of the near ones joins groups to clusters.
     No link leaves a cluster.
  3. Clusters of several groups are verified in blocks of nodes: each block meets each other one, but two blocks of one group,
     and gives the links that join its groups.

So dense groups cost their members and not their pairs, and no pair of another group is left out. The order puts
shingles that are frequent in a bounded sample last, so that boilerplate makes no buckets; any order gives the same links.

Sets are made from the texts in each pass and stored only for candidates. Null and empty texts have the empty set and are equal to each other. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Batches, as_bytes, components, key_groups, slices, written
from .simhash import _hashes, near_in_buckets, near_pairs, near_sets, set_signature, with_pivots

#: Only the order of shingles, so the cost and never the links, depends on these.
SAMPLE_NODES = 16_384
OFTEN, MOST_OFTEN = 3, 1 << 18
_PART_BYTES = 4 << 20
_BLOCK_NODES = 256


def distinct_shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(_hashes(text, shingle).view(np.uint64).ravel())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): mark is a hash of id and text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).alias("text"))


def _named(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set: its node."""
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _nodes(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, mark, node, size, signature) for each row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in slices(batch, 2, _PART_BYTES):
                sets = [distinct_shingles(t, shingle) for t in as_bytes(b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_named(sets)), pa.array([len(x) for x in sets], pa.int32()), pa.array([set_signature(x) for x in sets], pa.binary())], names=["id", "mark", "node", "size", "signature"])

    return rows.mapInArrow(run, "id long, mark long, node long, size int, signature binary")


def _frequent(rows: DataFrame, n_nodes: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those found often in a sample of the texts; shingles ascend."""

    def singly(batches: Batches) -> Batches:
        for batch in batches:
            for b in slices(batch, 0, _PART_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([distinct_shingles(t, shingle) for t in as_bytes(b.column(0))]).view(np.int64))], names=["key"])

    rate = min(1.0, SAMPLE_NODES / max(n_nodes, 1))
    sample = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(rate * (1 << 20))).distinct()
    counts = sample.mapInArrow(singly, "key long").groupBy("key").count().where(F.col("count") >= OFTEN)
    found = counts.orderBy(F.col("count").desc(), "key").limit(MOST_OFTEN).toArrow()
    keys = found.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column(1).to_numpy()[order]


def _prefix_length(n: int, share: Fraction) -> int:
    return n - -(-n * share.numerator // share.denominator) + 1 if n else 0


def _prefixes(rows: DataFrame, often: np.ndarray, counts: np.ndarray, shingle: int, share: Fraction) -> DataFrame:
    """(key, node, size): the prefix of each set."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in slices(batch, 0, _PART_BYTES):
                sets = [distinct_shingles(t, shingle) for t in as_bytes(b.column(0))]
                keys = [np.zeros(0, np.uint64)]
                for own in sets:
                    first = _prefix_length(len(own), share)
                    if len(own) and len(often):
                        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        own = own[np.argsort(np.where(often[at] == own, counts[at], 0), kind="stable")]
                    keys.append(own[:first])
                lengths = [len(k) for k in keys[1:]]
                sizes = np.array([len(s) for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(_named(sets), lengths)), pa.array(np.repeat(sizes, lengths))], names=["key", "node", "size"])

    return rows.select("text").mapInArrow(run, "key long, node long, size int")


def _candidates(met: DataFrame, share: Fraction) -> DataFrame:
    """(src, dst) from met (a, b: structs of node and size), one row for each shared prefix shingle.

    Of the set whose prefix ends first in the order, what lies behind the prefix is all that can be shared besides; so
    shared prefix shingles and the longer rest together bound the common ones.
    """
    p, q = share.numerator, share.denominator
    small, large = F.least("a.size", "b.size").cast("long"), F.greatest("a.size", "b.size").cast("long")
    sized = met.where(small * q >= large * p).groupBy("a", "b").count()
    rest = F.expr(f"(greatest(a.size, b.size) * {p}L + {q - 1}) div {q}") - 1  # size less the prefix length
    enough = (F.col("count") + rest) * (p + q) >= (small + large) * p
    return sized.where(enough).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))


def _similar(x: np.ndarray, y: np.ndarray, share: Fraction) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two ascending runs: merged
    common = int((both[1:] == both[:-1]).sum())
    return common * share.denominator >= (len(both) - common) * share.numerator


def _sets(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) for the nodes in wanted."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in slices(batch, 1, _PART_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([distinct_shingles(t, shingle).tobytes() for t in as_bytes(b.column(1))], pa.binary())], names=["node", "shingles"])

    marks = wanted.select("node").distinct().join(nodes.select("node", "mark"), "node")
    texts = rows.select("mark", "text").join(marks, "mark").dropDuplicates(["node"]).select("node", "text")
    return written(texts.mapInArrow(run, "node long, shingles binary"), "near-sets")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """The pairs (src, dst) whose whole sets are similar enough."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in slices(batch, 2, _PART_BYTES):
                keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "near-pairs")
    own = _sets(pairs.select(F.explode(F.array("src", "dst")).alias("node")), rows, nodes, shingle)
    one, other = (own.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in ("src", "dst"))
    joined = pairs.join(one, "src").join(other, "dst").select("src", "dst", "src_set", "dst_set")
    return written(joined.mapInArrow(run, "src long, dst long"), "near-links")


def _across(members: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """Links (src, dst) that join the groups of each cluster; members: cluster, group, node of clusters with several groups."""

    def run(batches: Batches) -> Batches:
        for x, cuts in key_groups(batches, "pair"):
            for a, b in zip(cuts, cuts[1:]):
                links = _group_links(*(x[c][a:b] for c in ("node", "group", "block", "shingles", "signature", "pivots")), share)
                if links:
                    src, dst = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    sizes = members.groupBy("cluster", "group").agg(F.count("*").alias("n"))
    small = sizes.groupBy("cluster").agg(F.sum(F.when(F.col("n") <= _BLOCK_NODES, F.col("n"))).alias("small"))
    # a group of more than one block has blocks of its own; the others share blocks
    own = F.col("n") > _BLOCK_NODES
    parts = F.ceil(F.when(own, F.col("n")).otherwise(F.col("small")) / _BLOCK_NODES)
    block = F.when(own, F.xxhash64("group", F.pmod(F.xxhash64("node"), parts))).otherwise(F.pmod(F.xxhash64("group"), parts).cast("long"))
    placed = written(members.join(sizes, ["cluster", "group"]).join(small, "cluster").select("cluster", "group", "node", block.alias("block"), F.when(own, F.col("group")).alias("owner")), "near-blocks")
    blocks = placed.select("cluster", "block", "owner").distinct()
    one, other = (blocks.select("cluster", F.col("block").alias(f"b{i}"), F.col("owner").alias(f"o{i}")) for i in (1, 2))
    meet = one.join(other, "cluster").where("b1 <= b2 and not coalesce(o1 = o2, false)").select("cluster", F.xxhash64("cluster", "b1", "b2").alias("pair"), F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    full = placed.join(meet, ["cluster", "block"]).join(_sets(placed, rows, nodes, shingle), "node").join(nodes.select("node", "signature", "pivots"), "node")
    ready = full.select("pair", "node", "group", "block", "shingles", "signature", "pivots").repartition("pair").sortWithinPartitions("pair", "node")
    return written(ready.mapInArrow(run, "src long, dst long"), "near-links")


def _group_links(node: np.ndarray, group: np.ndarray, block: np.ndarray, shingles: np.ndarray, signature: np.ndarray, pivots: np.ndarray, share: Fraction) -> list[tuple[int, int]]:
    """Links that join the groups in one pair of blocks: nearest signatures first, and none between what is joined already."""
    sets = [np.frombuffer(x, np.uint64) for x in shingles]
    sizes = np.array([len(x) for x in sets])
    bits, table = (np.frombuffer(b"".join(x), k).reshape(len(node), -1) for x, k in ((signature, np.uint64), (pivots, np.uint16)))
    names, joined = np.unique(group, return_inverse=True)  # the joined group of each node
    two = block.min() != block.max()
    links = []
    for i in range(len(node)):
        j = np.flatnonzero(joined != joined[i])
        j = j[(block[j] != block[i]) if two else (j > i)]
        for at, _ in zip(*near_sets(i, j, sizes, bits, table, float(share))):
            if joined[at] != joined[i] and _similar(sets[i], sets[at], share):
                links.append((int(node[i]), int(node[at])))
                joined[joined == joined[at]] = joined[i]
    return links


def similar_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, mark, component) for each row: equal components for rows that links of at least that similarity connect."""
    share = Fraction(similarity).limit_denominator(1000)
    rows = _rows(docs, id_col, text_col)
    marked = written(_nodes(rows, shingle), "near-marked")
    first_rows = marked.groupBy("node").agg(F.min(F.struct("mark", "size", "signature")).alias("x")).select("node", "x.*")
    nodes = written(first_rows.join(with_pivots(first_rows).select("node", "pivots"), "node"), "near-nodes")
    bucket = Window.partitionBy("key")
    own = F.struct("node", "size")
    entries = _prefixes(rows, *_frequent(rows, nodes.count(), shingle), shingle, share).repartition("key").dropDuplicates(["key", "node"])
    entries = entries.withColumns({"first": F.min(own).over(bucket), "last": F.max(own).over(bucket)}).where(F.col("first.node") != F.col("last.node"))
    entries = written(entries.select("key", "node", "size", "first", "last"), "near-prefixes")

    # a bucket's smallest and largest nodes are the same in most buckets of a dense group; where they are not, the second round compares
    stars = entries.select(F.explode(F.array("first", "last")).alias("lead"), own.alias("own")).where("lead.node <> own.node")
    stars = stars.select(F.least("lead", "own").alias("a"), F.greatest("lead", "own").alias("b"))
    links = _verified(near_pairs(_candidates(stars, share), nodes), rows, nodes, shingle, share)

    label = components(links, "near-groups").withColumnRenamed("component", "group")
    rest = entries.select("key", "node", "size").join(label, "node", "left").select("key", "node", "size", F.coalesce("group", "node").alias("group"))
    rest = rest.withColumns({"low": F.min("group").over(bucket), "high": F.max("group").over(bucket), "members": F.count("*").over(bucket)}).where("low <> high")
    rest = written(rest.select("key", "members", "node", "size"), "near-rest")
    forest = near_in_buckets(rest.join(nodes.select("node", "signature", "pivots"), "node"), similarity)
    cluster = components(links.union(forest), "near-clusters").withColumnRenamed("component", "cluster")
    members = cluster.join(label, "node", "left").select("cluster", F.coalesce("group", "node").alias("group"), "node")
    several = members.groupBy("cluster").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("cluster")
    more = _across(members.join(several, "cluster"), rows, nodes, shingle, share)

    parts = components(links.union(more), "near")
    return marked.join(parts, "node", "left").select("id", "mark", F.coalesce("component", "node").alias("component"))
