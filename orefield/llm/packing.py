"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Bins are ordered by what is left in them. A piece goes into the tightest bin that it fits and that holds
neither its source nor its duplicate cluster yet; each bin carries a bitmap of each. From
the piece's size the successor search walks up through the residuals until a bin is compatible. For
each residual the numbers of bins that already hold a source, and a cluster, are kept, so residuals
whose bins all hold the piece's source, or all its cluster, are passed over at once.

Documents longer than a bin are cut into whole-bin pieces and a rest; all pieces of a document conflict with
each other through its cluster. Pieces are dealt into shards of about shard_pieces by a hash of id
and piece, which mixes sources and sizes evenly, and each shard is packed alone, largest pieces first (ties by id,
piece): a hot source or cluster is spread over all shards. At most one partly filled tail of bins
per shard is the price.

Null ids, sources and clusters: a null source or cluster conflicts with nothing. Null and empty texts
have size 0 and get a piece of size 0. Repeated ids are packed once each row. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Batches, key_groups, written

CAPACITY = 2048
SHARD_PIECES = 20_000


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual
        self.count = np.zeros(capacity + 1, np.int64)
        self.holding: dict[int, np.ndarray] = {}  # source bit -> bins at each residual that hold it
        self.spread: dict[int, dict[int, int]] = {}  # cluster bit -> bins at each residual that hold it; most clusters are in one bin
        self.members: list[list[int]] = []  # source bits of each bin
        self.copies: list[list[int]] = []  # cluster bits of each bin
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.left: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin of a piece; source and cluster are bit numbers, -1 for none."""
        free = self.count[size:]
        if source >= 0:
            if source not in self.holding:
                self.holding[source] = np.zeros(self.capacity + 1, np.int64)
            free = free - self.holding[source][size:]
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        held = self.spread.get(cluster, {}) if cluster >= 0 else {}
        for residual in (np.flatnonzero(free > 0) + size).tolist():
            if held.get(residual, 0) == self.count[residual]:
                continue
            for b in self.bins_at[residual]:
                if not self.sources[b] & s and not self.clusters[b] & c:
                    self._put(b, size, source, cluster, s, c)
                    return b
        b = len(self.left)
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.members.append([])
        self.copies.append([])
        self.bins_at[self.capacity].append(b)
        self.count[self.capacity] += 1
        self._put(b, size, source, cluster, s, c)
        return b

    def _put(self, b: int, size: int, source: int, cluster: int, s: int, c: int) -> None:
        old, new = self.left[b], self.left[b] - size
        if new != old:
            self.bins_at[old].remove(b)
            insort(self.bins_at[new], b)
            self.count[old] -= 1
            self.count[new] += 1
            for m in self.members[b]:
                self.holding[m][old] -= 1
                self.holding[m][new] += 1
            for m in self.copies[b]:
                at = self.spread[m]
                at[old] -= 1
                at[new] = at.get(new, 0) + 1
            self.left[b] = new
        if source >= 0:
            self.members[b].append(source)
            self.holding[source][new] += 1
        if cluster >= 0:
            self.copies[b].append(cluster)
            at = self.spread.setdefault(cluster, {})
            at[new] = at.get(new, 0) + 1
        self.sources[b] |= s
        self.clusters[b] |= c


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, source, cluster, piece, size): sizes in words. Without cluster_col, texts with equal words share a cluster."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("words"), *([F.col(cluster_col).cast("long").alias("cluster")] if cluster_col else []))
    size = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.translate("words", " ", "")) + 1)
    cluster = F.col("cluster") if cluster_col else F.when(F.col("words") != "", F.xxhash64(F.lower("words")))
    sized = rows.select("id", "source", cluster.alias("cluster"), size.cast("long").alias("n"))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    return sized.select("id", "source", "cluster", "n", cut.alias("piece")).select("id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(id, piece, size, source, cluster, bin, position, start): start is the piece's first word in its bin; bin numbers are unique."""
    cut = written(pieces(docs, id_col=id_col, text_col=text_col, source_col=source_col, cluster_col=cluster_col, capacity=capacity), "packing-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def run(batches: Batches) -> Batches:
        for rows, cuts in key_groups(batches, "shard"):
            for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                shard = int(rows["shard"][a])
                packer = Packer(capacity)
                bits: tuple[dict, dict] = ({}, {})
                number, place, start = [], [], []
                filled: dict[int, tuple[int, int]] = {}
                for size, source, cluster in zip(rows["size"][a:e].tolist(), rows["source"][a:e].tolist(), rows["cluster"][a:e].tolist()):
                    known = [-1 if v is None else own.setdefault(v, len(own)) for v, own in zip((source, cluster), bits)]
                    b = packer.place(size, *known)
                    n, at = filled.get(b, (0, 0))
                    filled[b] = (n + 1, at + size)
                    number.append((shard << 32) + b)
                    place.append(n)
                    start.append(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["id"][a:e].tolist(), pa.int64()), pa.array(rows["piece"][a:e], pa.int32()), pa.array(rows["size"][a:e], pa.int32()), pa.array(rows["source"][a:e].tolist(), pa.string()), pa.array(rows["cluster"][a:e].tolist(), pa.string()), pa.array(number, pa.int64()), pa.array(place, pa.int32()), pa.array(start, pa.int32())],
                    names=["id", "piece", "size", "source", "cluster", "bin", "position", "start"],
                )

    dealt = cut.select(F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).alias("shard"), "id", "piece", "size", "source", F.col("cluster").cast("string").alias("cluster"))
    packed = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("size"), "id", "piece", "cluster").mapInArrow(run, "id long, piece int, size int, source string, cluster string, bin long, position int, start int")
    return packed.withColumn("cluster", F.col("cluster").cast("long"))
