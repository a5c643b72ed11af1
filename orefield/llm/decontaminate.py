"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton (each item is added from the initial state,
so no match crosses items). A training document's words stream through it; the state and the
length of the longest match are kept at each word. A match of window words or more marks the words it
covers. An item shorter than a window counts when it occurs whole.

The benchmark is a fixed test set, not part of the corpus. Its size is checked (max_item_words,
max_item_bytes) while it is read; a larger set is split into automata of that size, and a text streams
through each. An automaton is built from dicts and then frozen into flat arrays, which are broadcast. Null or empty texts and items have no words and never match. Items with equal words are all
reported. Repeated documents give a row each; extra columns stay,
but find replaces those named as the columns that it adds; remove keeps them too.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import beside, with_text_columns

WINDOW = 10
MAX_ITEM_WORDS = 500_000
MAX_ITEM_BYTES = 16 << 20
ADDED = ("n_words", "n_hit", "item_ids", "hit_spans")
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with what a match at each state reports."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    owners: list[set[int]] = field(default_factory=lambda: [set()])
    whole: dict[int, list[int]] = field(default_factory=dict)
    shortest: int = 0

    def _extend(self, last: int, word: int) -> int:
        found = self.step[last].get(word)
        if found is not None and self.length[found] == self.length[last] + 1:
            return found
        if found is not None:
            return self._split(last, word, found)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            target = self.step[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        self.owners.append(set())
        return len(self.step) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        copy = self._state(self.length[at] + 1)
        self.step[copy] = dict(self.step[old])
        self.link[copy] = self.link[old]
        self.owners[copy] = set(self.owners[old])
        self.link[old] = copy
        while at >= 0 and self.step[at].get(word) == old:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def build(self, items: list[tuple[str, list[bytes]]]) -> Automaton:
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for n, sequence in enumerate(sequences):
            at = 0
            for word in sequence:
                at = self.step[at][word]
                up = at
                while up > 0 and n not in self.owners[up]:
                    self.owners[up].add(n)
                    up = self.link[up]
        self.base = [-1] * len(self.step)  # the state of the last window words, where the state is that long
        for s in sorted(range(len(self.step)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.base[s] = self.base[up] if up >= 0 and self.length[up] >= self.window else s
        for n, sequence in enumerate(sequences):
            if 0 < len(sequence) < self.window:
                at = 0
                for word in sequence:
                    at = self.step[at][word]
                while self.length[self.link[at]] >= len(sequence):
                    at = self.link[at]
                self.whole.setdefault(at, []).append(n)
        sizes = [len(s) for s in sequences if s]
        self.shortest = min([self.window, *sizes]) if sizes else 0
        self.short_lengths = {s: len(sequences[ns[0]]) for s, ns in self.whole.items()}
        self.names = [name for name, _ in items]
        self._freeze()
        return self

    def _freeze(self) -> None:
        """Flat arrays instead of the dicts and sets of the build: edges of a state side by side, by word; owners of base states only."""
        self.edge, self.target, self.first = array("i"), array("i"), array("i", [0])
        for follow in self.step:
            for word in sorted(follow):
                self.edge.append(word)
                self.target.append(follow[word])
            self.first.append(len(self.edge))
        self.owned = {s: tuple(self.owners[s]) for s in set(self.base) if s >= 0}
        self.link, self.length, self.base = array("i", self.link), array("i", self.length), array("i", self.base)
        self.step, self.owners = [], []

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end) covered by windows, in order and merged, and the items they come from."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, items
        number = np.fromiter(map(self.vocabulary.get, words, _minus), np.int64, len(words))
        gaps = np.flatnonzero(number < 0)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(words)]])
        for lo, hi in zip(*(x[ends - starts >= self.shortest].tolist() for x in (starts, ends))):
            self._stream(number[lo:hi].tolist(), lo, spans, items)
        return spans, items

    def _stream(self, run: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        first, edge, target, link, length, window, whole = self.first, self.edge, self.target, self.link, self.length, self.window, self.whole
        at = matched = 0
        for i, word in enumerate(run, offset + 1):
            while True:
                stop = first[at + 1]
                place = bisect_left(edge, word, first[at], stop)
                if place < stop and edge[place] == word:
                    at = target[place]
                    matched += 1
                    break
                if not at:
                    break
                at = link[at]
                matched = length[at]
            if matched >= window:
                items.update(self.owned[self.base[at]])
                _cover(spans, i - window, i)
            if whole:
                up = at
                while up > 0:
                    if up in whole and self.short_lengths[up] <= matched:
                        items.update(whole[up])
                        _cover(spans, i - self.short_lengths[up], i)
                    up = link[up]


class _Minus:
    def __iter__(self):
        return self

    def __next__(self) -> int:
        return -1


_minus = _Minus()


def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
    while spans and spans[-1][1] >= start:
        a, b = spans.pop()
        start, end = min(a, start), max(b, end)
    spans.append((start, end))


def load_items(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS, max_item_bytes: int = MAX_ITEM_BYTES) -> list[Automaton]:
    """Automata over the whole benchmark, each over at most max_item_words words of max_item_bytes (one item may exceed them alone)."""
    made: list[Automaton] = []
    part: list[tuple[str, list[bytes]]] = []
    size = volume = 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of((row["t"] or "").encode())
        if part and (size + len(words) > max_item_words or volume + sum(map(len, words)) > max_item_bytes):
            made.append(Automaton(window).build(part))
            part, size, volume = [], 0, 0
        part.append((str(row["i"]), words))
        size += len(words)
        volume += sum(map(len, words))
    return [*made, Automaton(window).build(part)]


def find(docs: DataFrame, automata: list[Automaton], *, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings) and spans of hit words (word positions, end exclusive)."""
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in automata]

    def run(texts: list[bytes]) -> list[pa.Array]:
        n_words, n_hit, ids, spans = [], [], [], []
        for text in texts:
            words = words_of(text)
            hit: list[tuple[int, int]] = []
            names: set[str] = set()
            for one in shared:
                covered, items = one.value.matches(words)
                for a, b in covered:
                    hit.append((a, b))
                names.update(one.value.names[n] for n in items)
            merged: list[tuple[int, int]] = []
            for a, b in sorted(hit):
                _cover(merged, a, b)
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in merged))
            ids.append(sorted(names))
            spans.append([list(x) for x in merged])
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]

    return with_text_columns(docs, text_col, "n_words bigint, n_hit bigint, item_ids array<string>, hit_spans array<array<bigint>>", run)


def remove(docs: DataFrame, automata: list[Automaton], *, text_col: str = "text", max_coverage: float = 0.0) -> DataFrame:
    """Documents without benchmark passages: hit words go, and documents of which more than max_coverage of the words is hit go whole.

    The columns stay as they are. With max_coverage 0 each contaminated document goes.
    """

    def clean(rows: DataFrame) -> DataFrame:
        kept = find(rows, automata, text_col=text_col).where(f"n_hit <= {float(max_coverage)!r} * n_words")
        if max_coverage > 0:
            kept = kept.withColumn(text_col, F.when(F.col("n_hit") > 0, F.udf(_without, StringType())(F.col(text_col), F.col("hit_spans"))).otherwise(F.col(text_col)))
        return kept

    return beside(docs, ADDED, clean)


def _without(text: str, spans: list[list[int]]) -> str:
    raw, mapped = text.encode(), text.encode().translate(_KEEP)
    places, at = [], 0
    for word in mapped.split():
        at = mapped.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
