"""Merkle manifest of a dataset: a root for the table, one for each source, and a witness for each row.

Leaves are appended source by source in id order. A run of ARITY nodes closes when its last sibling
is appended; closing attaches to each child the digests to its left and right, which every leaf below it shares, so the
partial witnesses of an open subtree grow by one step without touching its leaves. Blocks of
ARITY ** HEIGHT leaves are aligned, so tasks append to them apart from one another; a block's root is a further append to the
same tree one round up, and its witness there extends the block's. The roots of the sources are appended to
the last tree in the same way. A round leaves one node in 256, and only the number of rounds reaches the driver.

Nulls are part of a leaf ('-'). Rows order by id (null first), then by leaf, so that ties and repeated rows
have one defined tree. A null source is a source of its own and comes first. An empty table has no rows. Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.relational import running_number
from ._common import written

ARITY = 16
HEIGHT = 2
BLOCK = ARITY**HEIGHT
_STEPS = "array<struct<left: string, right: string>>"
Steps = list[tuple[str, str]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each '-' if null, else its UTF-8 byte count, ':' and its value."""
    def plain(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[plain(f) for f in fields]), 256)


class Tree:
    """An append-only tree. Every node has a step (left, right): its siblings' digests, known once its run is closed.

    witness(i) is the path of steps of leaf i from the bottom to the root, after finish().
    """

    def __init__(self) -> None:
        self.open: list[list[str]] = [[]]  # digests of the open run of each level
        self.steps: list[list[tuple[str, str]]] = []
        self.count = 0

    def append(self, node: str, level: int = 0) -> None:
        if level == 0:
            self.count += 1
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run = self.open[level]
        while len(self.steps) <= level:
            self.steps.append([])
        self.steps[level] += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
        self.open[level] = []
        self.append(digest(*run), level + 1)

    def finish(self, height: int | None = None) -> str:
        """The root: of the given height, or of the least height that leaves one node."""
        if height is None:
            height, left = 0, self.count
            while left > 1:
                height, left = height + 1, -(-left // ARITY)
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._close(level)
        return self.open[height][0]

    def witness(self, i: int, height: int) -> list[tuple[str, str]]:
        return [self.steps[level][i // ARITY**level] for level in range(height)]


def fold(node: str, steps: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf and its witness lead to."""
    for left, right in steps:
        node = digest(left, node, right)
    return node


def witness_hash(steps: Iterable[tuple[str, str]]) -> str:
    return digest(*[x for step in steps for x in step])


def _grown(nodes: Sequence[str], whole: bool) -> tuple[Tree, str, int]:
    """The tree over a block's nodes, its root and height. whole: the tree's only block, which ends at its own root."""
    tree = Tree()
    for n in nodes:
        tree.append(n)
    height = HEIGHT
    if whole:
        height, left = 0, len(nodes)
        while left > 1:
            height, left = height + 1, -(-left // ARITY)
    return tree, tree.finish(height), height


def _blocks(nodes: DataFrame, sizes: DataFrame, tag: str, keep: Sequence[str] = ()) -> DataFrame:
    """(tree, block, nodes, size, root): aligned blocks of (tree, at, node) with their roots; size: the nodes of the whole tree."""
    held = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("at", "node", *keep))).alias("nodes"))
    held = held.join(sizes.withColumnRenamed("tree", "_of"), F.col("tree").eqNullSafe(F.col("_of"))).select("tree", "block", "nodes", "size")

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ends = batch.column(2).flatten().field("node").to_pylist(), batch.column(2).value_lengths().to_pylist()
            roots, start = [], 0
            for n, size in zip(ends, batch.column(3).to_pylist()):
                roots.append(_grown(nodes[start : start + n], size <= BLOCK)[1])
                start += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    return written(held.mapInArrow(rooted, StructType([*held.schema.fields, StructField("root", StringType())])), tag)


def _rounds(nodes: DataFrame, sizes: DataFrame, tag: str, keep: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """Blocks of nodes, blocks of their roots and so on until every tree has one: (roots (tree, root), blocks of each round)."""
    rounds = [_blocks(nodes, sizes, tag, keep)]
    roots = rounds[0].where(F.col("size") <= BLOCK).select("tree", "root")
    while not (more := rounds[-1].where(F.col("size") > BLOCK)).isEmpty():
        sizes = sizes.where(F.col("size") > BLOCK).withColumn("size", F.ceil(F.col("size") / BLOCK))
        rounds.append(_blocks(more.select("tree", F.col("block").alias("at"), F.col("root").alias("node")), sizes, tag))
        roots = roots.union(rounds[-1].where(F.col("size") <= BLOCK).select("tree", "root"))
    return roots, rounds


def _witnessed(blocks: DataFrame, above: DataFrame | None, fields: str, make: Callable[[dict, dict, Steps], dict], extra: Sequence[str] = ()) -> DataFrame:
    """Rows that make(block row, node, steps) gives for each node: steps within its block, extended by the block's own of above (tree, at, steps)."""
    none = F.array().cast(_STEPS)
    if above is None:
        found = blocks.withColumn("above", none)
    else:
        up = above.select(F.col("tree").alias("_of"), F.col("at").alias("_at"), F.col("steps").alias("_steps"))
        found = blocks.join(up, F.col("tree").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_at")), "left").withColumn("above", F.coalesce("_steps", none))
    found = found.select("tree", "size", "nodes", "above", *extra)
    target = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                tree, _, height = _grown([n["node"] for n in row["nodes"]], row["size"] <= BLOCK)
                upper = _pairs(row["above"])
                yield pa.RecordBatch.from_pylist([make(row, n, tree.witness(k, height) + upper) for k, n in enumerate(row["nodes"])], schema=target)

    return found.mapInArrow(run, fields)


def _pairs(steps: list[dict]) -> Steps:
    return [(s["left"], s["right"]) for s in steps]


def _named(steps: Steps) -> list[dict]:
    return [{"left": a, "right": b} for a, b in steps]


def _upper(rounds: list[DataFrame]) -> DataFrame | None:
    """(tree, at, steps): witnesses of the first round's block roots, built from the last round down; None if no tree has two blocks."""
    found = None
    for blocks in reversed(rounds[1:]):
        found = written(_witnessed(blocks, found, f"tree string, at bigint, steps {_STEPS}", lambda row, n, steps: {"tree": row["tree"], "at": n["at"], "steps": _named(steps)}), "merkle-steps")
    return found


def manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, source, leaf, subroot, root, proof_sha256, folded_root, verified): one row a row of docs.

    altered: columns as a later, perhaps tampered, copy holds them in rows where the condition is true; the tree is of docs itself.
    folded_root is what the (altered) leaf and the row's witness lead to, and verified says whether that is the root.
    """
    changed = F.when(where, leaf([(altered or {}).get(f, F.col(f)) for f in fields])) if altered else F.lit(None).cast("string")
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("tree"), leaf([F.col(f) for f in fields]).alias("node"), changed.alias("changed"))
    leaves = written(leaves, "merkle-leaves")  # ranges are sampled first: texts are read once
    placed = written(running_number(leaves, [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node")], "n"), "merkle-leaves")
    spans = written(placed.groupBy("tree").agg(F.count("*").alias("size"), F.min("n").alias("first")), "merkle-spans")
    nodes = placed.join(spans.select(F.col("tree").alias("_of"), "first"), F.col("tree").eqNullSafe(F.col("_of"))).withColumn("at", F.col("n") - F.col("first"))
    roots, rounds = _rounds(nodes, spans.select("tree", "size"), "merkle-blocks", ["id", "changed"])

    ordered = running_number(roots.withColumnRenamed("tree", "name"), [F.col("name").asc_nulls_first()], "n")
    ordered = written(ordered.select(F.lit("").alias("tree"), (F.col("n") - 1).alias("at"), F.col("root").alias("node"), "name"), "merkle-sources")
    top, top_rounds = _rounds(ordered, ordered.groupBy("tree").agg(F.count("*").alias("size")), "merkle-top", ["name"])
    top_root = top.first()
    root = top_root["root"] if top_root else ""
    sources = written(_witnessed(top_rounds[0], _upper(top_rounds), f"tree string, subroot string, source_steps {_STEPS}", lambda row, n, steps: {"tree": n["name"], "subroot": n["node"], "source_steps": _named(steps)}), "merkle-sources")

    def row(block: dict, n: dict, steps: Steps) -> dict:
        steps = steps + _pairs(block["source_steps"])
        folded = fold(n["changed"] or n["node"], steps)
        return {"id": n["id"], "source": block["tree"], "leaf": n["node"], "subroot": block["subroot"], "root": root, "proof_sha256": witness_hash(steps), "folded_root": folded, "verified": folded == root}

    full = rounds[0].join(sources.withColumnRenamed("tree", "_name"), F.col("tree").eqNullSafe(F.col("_name"))).drop("_name")
    kind = leaves.schema["id"].dataType.simpleString()
    return _witnessed(full, _upper(rounds), f"id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", row, ["subroot", "source_steps"])
