"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

The kept terms of a language get dense ids, and ids are cut into aligned ranges. Over one range each source's counts
form a binary segment tree. Trees are hash-consed: nodes are named by their children's names, so equal
count subtrees, of whatever source and place, are one node. Two trees are walked together from the roots,
level by level, and a pair of nodes that is met again only adds to how often it occurs; each pair of different counts
is priced once. Ranges are independent: a language of any size is dealt over tasks, and a task holds one
range of at most WIDTH terms of all sources of a language.

Null text, language and source count as ''. Groups without terms and languages without kept terms still have their
pairs, with value 0. Repeated rows count as rows. An empty table gives no rows. Columns other than the three are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import running_number
from ._common import as_bytes, slices, written

#: Parts per SCALE are the unit of a probability.
SCALE = 1_000_000_000
WIDTH = 4096
#: Entries that a task counts before it hands them on.
_HELD = 1 << 20
#: Letters A to Z lower-cased; every byte that cannot be in a term becomes a space. Bytes above 0x7F are parts of letters.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) for each term of each group; an entry with the term '' shows that the group exists."""
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
        within: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in seen.items():
                terms = list(own)
                df = within[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()
            within.clear()

        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                    terms = text.translate(_LETTERS).split()
                    seen[lang, source].update(terms)
                    seen[lang, source][b""] += 0
                    within[lang, source].update(set(terms))
                if sum(map(len, seen.values())) > _HELD:
                    yield from handed()
        yield from handed()

    found = plain.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals below 9 * 10^15: long division, three digits at a time."""
    rest, out = count.astype(np.int64) + 1, np.zeros(np.shape(count), np.int64)
    total = np.asarray(total, np.int64)
    out += rest // total * SCALE
    rest = rest % total
    for place in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out += rest // total * place
        rest = rest % total
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); the square of a difference of at most SCALE fits 64 bits."""
    return (p - q) ** 2 // q


class Trees:
    """Hash-consed binary segment trees over a range of ids, one for each row of a count matrix.

    A leaf is named by its count's place among the different counts, a node by the place of its pair of child names among the different
    pairs of its level, so equal subtrees have one name.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, names = np.unique(counts, return_inverse=True)
        names, self.children = names.reshape(counts.shape), []
        self.most = len(self.counts)
        while names.shape[1] > 1:
            n = int(names.max()) + 1
            nodes, at = np.unique(names[:, 0::2].ravel() * n + names[:, 1::2].ravel(), return_inverse=True)
            self.children.append((nodes // n, nodes % n))
            names = at.reshape(names.shape[0], -1)
            self.most = max(self.most, len(nodes))
        self.roots = names[:, 0]

    def meet(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(other, count of one, count of other, times): each different pair of counts of a tree and another, once."""
        m = self.most
        who, a, b, times = np.arange(len(others)), np.full(len(others), self.roots[one]), self.roots[others], np.ones(len(others), np.int64)
        for left, right in reversed(self.children):
            key = np.tile(who, 2) * m * m + np.concatenate([left[a], right[a]]) * m + np.concatenate([left[b], right[b]])
            order = np.argsort(key)
            key, times = key[order], np.tile(times, 2)[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, times = key[first], np.add.reduceat(times, first)
            who, a, b = key // (m * m), key // m % m, key % m
        return who, self.counts[a], self.counts[b], times


def _range_values(counts: np.ndarray, totals: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its value against every other row, summed over the range."""
    trees = Trees(counts)
    step = max(1, (1 << 62) // trees.most**2)  # others whose keys of a pair of nodes fit 64 bits
    for one in range(len(counts)):
        out = np.zeros(len(counts), np.int64)
        for start in range(0, len(counts), step):
            who, a, b, times = trees.meet(one, np.arange(start, min(start + step, len(counts))))
            np.add.at(out, who + start, price(probability(a, totals[one]), probability(b, totals[who + start])) * times)
        yield one, out


def audit(docs: DataFrame, *, least_docs: int = 3, top_terms: int = 200, width: int = WIDTH, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank).

    part pair: every other source of the language with the summed divergence of the group from it. part term: the terms
    that the group uses more than its language does, at most top_terms of them. Ranks go by value
    descending, then item in UTF-8 order.
    """
    counts = written(term_counts(docs, **columns), "divergence-counts")
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("own")).where(F.col("docs") >= least_docs).drop("docs")
    # frequent terms apart from rare ones: ranges of rare terms have few different subtrees
    at = running_number(terms, [F.col("lang"), F.col("n"), F.col("term")], "at")
    at = written(at, "divergence-terms")
    sizes = at.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("at").alias("first"))
    own = at.select("lang", F.explode("own").alias("o")).groupBy("lang", F.col("o.source").alias("source")).agg(F.sum("o.n").alias("n"))
    groups = written(counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").fillna(0, ["n"]), "divergence-groups")
    named = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    about = sizes.withColumnRenamed("n", "lang_n").join(named, "lang")
    about = written(about, "divergence-langs")
    ranges = at.join(about.select("lang", "first"), "lang").withColumn("at", F.col("at") - F.col("first"))
    ranges = ranges.withColumn("range", F.floor(F.col("at") / width)).groupBy("lang", "range").agg(F.collect_list(F.struct((F.col("at") % width).cast("int").alias("at"), "term", "n", "own")).alias("terms"))
    full = ranges.join(about, "lang").select("lang", "v", "lang_n", "groups", "terms")

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, v, lang_n, found, entries = (batch.column(c)[i].as_py() for c in range(5))
                place = {g["source"]: k for k, g in enumerate(found)}
                totals = np.array([g["n"] + v for g in found], np.int64)
                matrix = np.zeros((len(found), width), np.int64)
                whole = np.zeros(width, np.int64)
                words = [""] * width
                for e in entries:
                    whole[e["at"]], words[e["at"]] = e["n"], e["term"]
                    for o in e["own"]:
                        matrix[place[o["source"]], e["at"]] = o["n"]
                # places without a term would be priced like terms of count 0: they are cut from the last range
                used = len(entries)
                rows: list[tuple[str, str, str, int]] = []
                q = probability(whole[:used], lang_n + v)
                span = 1 << max(0, used - 1).bit_length()
                for one, values in _range_values(matrix[:, :span], totals):
                    if span > used:  # the padding's pairs of zeros
                        zero = np.zeros(len(found), np.int64)
                        values = values - (span - used) * price(probability(zero, totals[one]), probability(zero, totals))
                    rows += [(found[one]["source"], "pair", g["source"], int(x)) for k, (g, x) in enumerate(zip(found, values)) if k != one]
                    p = probability(matrix[one, :used], totals[one])
                    mine = np.flatnonzero((matrix[one, :used] > 0) & (p > q))
                    best = sorted(((-int(x), words[k]) for x, k in zip(price(p[mine], q[mine]), mine)), key=lambda x: (x[0], x[1].encode()))[:top_terms]
                    rows += [(found[one]["source"], "term", w, -x) for x, w in best]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], ["lang", "source", "part", "item", "value"])

    found = written(full.mapInArrow(priced, "lang string, source string, part string, item string, value bigint"), "divergence-values")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
