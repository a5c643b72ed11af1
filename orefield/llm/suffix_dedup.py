"""Removal of long repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of length bytes that covers it starts anywhere else too. Every such string
holds a core of core bytes: the one whose hash is lowest among its cores (the leftmost if equal). Equal strings
choose equal cores, so only suffixes that start at a chosen core and meet in the same core group
need an order. Around a core, what decides is how far two places agree to the right (suffix) and
to the left (reversed prefix).

  1. Each document gives its cores with a hash of the core and one of the core's whole surroundings.
  2. Places whose whole surroundings are equal are covered at once, and one of them stands for all: first inside
     salts, so that a large group of copies is spread over tasks, then among what stands for each salt.
  3. The other surroundings of a core group are sorted by what follows and by what precedes the
     core: multikey quicksort to a shallow depth, blind tries below it for groups with a longer
     common prefix. Common-prefix lengths of neighbours cut each order into classes; a string of length bytes that
     reaches i bytes left of the core repeats if its left class at i and right class at
     length - core - i hold another member together. All these strings share the core, so
     they cover one stretch, from the furthest left to the furthest right.
  4. A core with more kinds of surroundings than one task should sort is replaced by wider cores: about SHRINK of
     them, each with all but a part of the bytes of the strings that begin near one another, so the same steps 2 and 3
     apply to less surroundings and smaller groups. Those that are still too common are widened again, at last to
     whole strings, which need no order: equal ones are covered.

Surroundings count as equal if two independent 64-bit hashes agree, of the core and of the whole.

Null and empty texts, and texts shorter than length, lose nothing. Repeated rows repeat each other.
The two passes name a row by its id and a hash of id and text. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Batches, BatchFunction, as_bytes, key_groups, written

LENGTH = 400
CORE = 200
SHALLOW = 8
SALTS = 256
CROWD = 12
SHRINK = 5
_COVERED, _STANDS, _CROWDED, _NOTICE = range(4)
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BATCH_BYTES = 4 << 20
_BATCH_MEMBERS = 20_000


# --- sorting ------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (8 * n - x.bit_length()) // 8 if x else n


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """members in the order of their strings. Inner nodes keep a depth and one byte for each child, never the strings."""
    root: list | None = None  # inner node: [depth, {byte: child}]; leaf: (member, ...) with equal strings
    for m in members:
        s = strings[m]
        if root is None:
            root = (m,)
            continue
        at = root
        while isinstance(at, list):  # blind: bytes between the depths are not looked at
            kids = at[1]
            at = kids.get(s[at[0]] if at[0] < len(s) else -1) or next(iter(kids.values()))
        other = strings[at[0]]
        same = common(s, other)
        mine = s[same] if same < len(s) else -1
        parent, edge, at = None, None, root
        while isinstance(at, list) and at[0] < same:
            parent, edge = at, s[at[0]]
            at = at[1][edge]
        if isinstance(at, list) and at[0] == same:
            at[1][mine] = (*at[1].get(mine, ()), m)
            continue
        if same == len(s) == len(other) and not isinstance(at, list):
            node = (*at, m)
        else:
            node = [same, {other[same] if same < len(other) else -1: at, mine: (m,)}]
        if parent is None:
            root = node
        else:
            parent[1][edge] = node
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack += [at[1][b] for b in sorted(at[1], reverse=True)]
        elif at:
            out += at
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of strings and each one's common prefix with the one before it (-1 for the first)."""
    order: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            order += group
        elif len(group) == 2:
            a, b = group
            order += group if strings[a] <= strings[b] else (b, a)
        elif depth >= shallow:
            order += blind_trie(strings, group)
        else:
            pivot = strings[group[len(group) // 2]][depth : depth + 1]
            less, same, more = [], [], []
            for m in group:
                b = strings[m][depth : depth + 1]
                (same if b == pivot else less if b < pivot else more).append(m)
            todo += [(g, d) for g, d in ((more, depth), (same, depth + 1 if pivot else shallow), (less, depth)) if g]
    return order, [-1, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))]


def repeats(groups: np.ndarray, left: list[bytes], right: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member (sorted by group) the fewest and the most bytes left of its core at which a repeated string begins; -1 where none does.

    left: the bytes before the core, nearest first; right: those behind it. A string takes i bytes on the left and reach - i on the right.
    """
    n = len(groups)
    cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), n]
    orders, shared = np.empty((2, n), np.int64), np.empty((2, n), np.int64)
    for side, strings in enumerate((left, right)):
        for a, b in zip(cuts, cuts[1:]):
            order, same = deep_shallow(strings[a:b])
            orders[side, a:b] = np.add(order, a)
            shared[side, a:b] = same
    fewest, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    classes = np.empty((2, n), np.int64)
    longest = np.minimum([len(x) for x in left], reach)
    shortest = np.maximum(reach - np.array([len(x) for x in right]), 0)
    for i in range(reach + 1):
        if not ((longest >= i) & (shortest <= i)).any():
            continue
        for side, need in ((0, i), (1, reach - i)):
            classes[side, orders[side]] = np.cumsum(shared[side] < need)
        pair = classes[0] * (n + 1) + classes[1]
        order = np.argsort(pair, kind="stable")
        equal = pair[order[1:]] == pair[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        twice &= (longest >= i) & (shortest <= i)
        fewest[twice & (fewest < 0)] = i
        most[twice] = i
    return fewest, most


# --- cores ----------------------------------------------------------------------


def _window_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each size-byte window, by doubling."""
    values = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([b]), seed=3) for b in range(256)), np.uint64)
    with np.errstate(over="ignore"):
        have, width, power, out, done = values[data], 1, np.uint64(_BASE), None, 0
        rest = size
        while rest:
            if rest & 1:
                if out is None:
                    out, done = have, width
                else:
                    n = len(data) - done - width + 1
                    out = out[:n] * power + have[done : done + n]
                    done += width
            rest >>= 1
            if rest:
                n = len(have) - width
                have = have[:n] * power + have[width : width + n]
                power, width = power * power, width * 2
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _window_min(values: np.ndarray, size: int) -> np.ndarray:
    have, width = values, 1
    while width * 2 <= size:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return np.minimum(have[: len(values) - size + 1], have[size - width :]) if size > width else have


def cores(texts: list[bytes], length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each chosen core; places ascend within a text."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64(max(28, len(data).bit_length()))  # places; the bits above hold the hash
    hashed = _window_hash(data, core) >> low << low | np.arange(len(data) - core + 1, dtype=np.uint64)
    lowest = _window_min(hashed, length - core + 1)
    inside = np.zeros(len(data), np.int8)
    for b, e in zip(begins[lengths >= length].tolist(), ends[lengths >= length].tolist()):
        inside[b : e - length + 1] = 1
    places = np.unique(lowest[inside[: len(lowest)] > 0] & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    owner = np.searchsorted(ends, places, side="right")
    return owner, places - begins[owner]


# --- operator ------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch, limit: int = _BATCH_BYTES):
    """Slices of a batch with about limit bytes of text each."""
    texts = as_bytes(batch.column(batch.num_columns - 1))
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it in any column."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _narrower(core: int, second: int, left: bytes, right: bytes, reach: int, step: int):
    """(core, whole, second, shift, left, right) of wider cores of one place, with step bytes of surroundings: each stands for
    the strings that begin shift to shift + step bytes left of the old core. Together they stand for all of them."""
    for a in sorted({min(x, reach - step) for x in range(0, reach + 1, step + 1)}):
        behind = reach - a - step
        if a <= len(left) and behind <= len(right):
            same = left[:a] + right[:behind]
            le, ri = left[a : a + step], right[behind : behind + step]
            also = xxhash.xxh64_intdigest(same, seed=(second + a) & _MASK)
            yield xxhash.xxh3_64_intdigest(same, seed=(core + a) & _MASK), xxhash.xxh64_intdigest(le + ri, seed=(also + len(le)) & _MASK), also, a, le, ri


def _less(reach: int, shrink: int) -> int:
    """The surroundings that the next wider cores leave open; in the end none."""
    return reach // shrink if reach >= 2 * shrink else 0


class _Rows:
    """Columns of one Arrow batch of places with their surroundings."""

    fields = [("wider", pa.bool_()), ("core", pa.int64()), ("whole", pa.int64()), ("second", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("place", pa.int64()), ("before", pa.int16()), ("behind", pa.int16()), ("left", pa.binary()), ("right", pa.binary())]
    ddl = "wider boolean, core long, whole long, second long, id long, mark long, place long, before short, behind short, left binary, right binary"

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, wider: bool, reach: int, length: int, core: int, whole: int, second: int, id_: int, mark: int, place: int, left: bytes, right: bytes) -> None:
        signed = [x - (1 << 64) if x >> 63 == 1 else x for x in (core, whole, second)]
        self.rows.append((wider, *signed, id_, mark, place, len(left), length - reach + len(right), left, right))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.fields)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, self.fields)], names=[n for n, _ in self.fields])


def _meet(found: DataFrame, crowd: int, carried: str = "") -> DataFrame:
    """Places met by (core, whole): those covered have start and end; way 1 asks for a comparison inside the core's group,
    way 2 for wider cores, as the group has too many kinds of surroundings for one task.

    A group is dealt over salts by place. A salt that holds more than crowd kinds sends them on by core and whole and a
    notice to the core's own group; what other salts sent there follows. So no group exceeds SALTS * (crowd + 1) rows.
    """
    names = ["core", "whole", "id", "mark", "place", "before", "behind", *(c.split()[0] for c in carried.split(",") if c)]
    kinds = {c: dict(_Rows.fields)[c] for c in names}
    extra = f", {carried}" if carried else ""

    def collapsed(batches: Batches) -> Batches:
        """Of places with equal surroundings in one salt, one stands for all (marked twice); the others are covered and go their own way."""
        for rows, _ in key_groups(batches, "core"):
            core, salt, whole = rows["core"], rows["salt"], rows["whole"]
            group, kind = _changes(core, salt), _changes(core, salt, whole)
            of_group, of_kind = np.cumsum(group) - 1, np.cumsum(kind) - 1
            twice = np.bincount(of_kind)[of_kind] > 1
            crowded = np.bincount(of_group, weights=kind)[of_group] > crowd
            own = whole ^ (rows["mark"] * 31 + rows["place"])
            mixed = core ^ (whole * np.int64(0x5851F42D4C957F2D))
            key = np.where(kind, np.where(crowded, mixed, core), own)
            state = np.where(kind, np.where(crowded, _CROWDED, _STANDS), _COVERED).astype(np.int8)
            notice = np.flatnonzero(group & crowded)
            take = np.concatenate([np.arange(len(core)), notice])
            key = np.concatenate([key, core[notice]])
            state = np.concatenate([state, np.full(len(notice), _NOTICE, np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(state), pa.array(twice[take]), *(pa.array(rows[c][take], kinds[c]) for c in names)], names=["key", "state", "twice", *names])

    def grouped(batches: Batches) -> Batches:
        for rows, _ in key_groups(batches, "key"):
            state, core, whole, key = rows["state"], rows["core"], rows["whole"], rows["key"]
            group, kind = _changes(key, core), _changes(key, core, state, whole)
            of_group, of_kind = np.cumsum(group) - 1, np.cumsum(kind) - 1
            twice = (np.bincount(of_kind)[of_kind] > 1) | (np.bincount(of_kind, weights=rows["twice"])[of_kind] > 0)
            noticed = np.bincount(of_group, weights=state == _NOTICE)[of_group] > 0
            several = np.bincount(of_group, weights=kind & (state == _STANDS))[of_group] > 1
            stands = kind & (state == _STANDS)
            way = np.where(kind & (state == _CROWDED) | stands & noticed, 2, np.where(stands & several, 1, 0)).astype(np.int8)
            use = (state != _NOTICE) & (twice | (way > 0))
            if use.any():
                place = rows["place"].astype(np.int64)
                start, end = np.where(twice, place - rows["before"], -1), np.where(twice, place + rows["behind"], -1)
                yield pa.RecordBatch.from_arrays([pa.array(way[use]), pa.array(start[use]), pa.array(end[use]), *(pa.array(rows[c][use], kinds[c]) for c in names)], names=["way", "start", "end", *names])

    ddl = f"core long, whole long, id long, mark long, place long, before short, behind short{extra}"
    found = found.select(*names).withColumn("salt", F.pmod(F.xxhash64("id", "mark", "place"), F.lit(SALTS)).cast("int"))
    found = found.repartition("core", "salt").sortWithinPartitions("core", "salt", "whole").mapInArrow(collapsed, f"key long, state byte, twice boolean, {ddl}")
    return found.repartition("key").sortWithinPartitions("key", "core", "state", "whole").mapInArrow(grouped, f"way byte, start long, end long, {ddl}")


def _compared(near: DataFrame, reach: int, length: int) -> DataFrame:
    """(id, mark, start, end) of the repeated stretches of places that share a core."""

    def compare(batches: Batches) -> Batches:
        for rows, cuts in key_groups(batches, "core"):
            at = 0
            while at < len(cuts) - 1:  # as many whole groups at a time as make a good batch
                to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _BATCH_MEMBERS, side="right")) - 1)
                part = slice(cuts[at], cuts[to])
                fewest, most = repeats(rows["core"][part], list(rows["left"][part]), list(rows["right"][part]), reach)
                hit = fewest >= 0
                if hit.any():
                    p = rows["place"][part][hit]
                    yield pa.RecordBatch.from_arrays([pa.array(rows["id"][part][hit], pa.int64()), pa.array(rows["mark"][part][hit]), pa.array(p - most[hit]), pa.array(p - fewest[hit] + length)], names=["id", "mark", "start", "end"])
                at = to

    near = near.select("core", "id", "mark", "place", "left", "right")
    return near.repartition("core").sortWithinPartitions("core").mapInArrow(compare, "id long, mark long, start long, end long")


def covered_spans(docs: DataFrame, *, length: int = LENGTH, core: int = CORE, crowd: int = CROWD, shrink: int = SHRINK) -> DataFrame:
    """(id, mark, start, end) of stretches to remove, for docs (id, mark, text). They may overlap."""
    reach = length - core
    step = _less(reach, shrink)

    def places(batches: Batches) -> Batches:
        for b in batches:
            for part, texts in _pieces(b):
                owner, at = cores(texts, length, core)
                if not len(at):
                    continue
                keys, whole = [], []
                for o, p in zip(owner.tolist(), at.tolist()):
                    t = texts[o]
                    keys.append(xxhash.xxh3_64_intdigest(t[p : p + core]))
                    lo = p - reach if p > reach else 0
                    whole.append(xxhash.xxh3_64_intdigest(t[lo : p + length], seed=p - lo))
                take = pa.array(owner)
                ends = np.array([len(texts[o]) for o in owner.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(whole, np.uint64).view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(at), pa.array(np.minimum(at, reach).astype(np.int16)), pa.array(np.minimum(ends - at, length).astype(np.int16))],
                    names=["core", "whole", "id", "mark", "place", "before", "behind"],
                )

    def surroundings(batches: Batches) -> Batches:
        for b in batches:
            out = _Rows()
            for i, m, wanted, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), as_bytes(b.column(3))):
                for x in wanted:
                    p, key = x["place"], x["core"]
                    left, right = t[max(0, p - reach) : p][::-1], t[p + core : p + length]
                    if x["way"] == 1:
                        out.add(False, reach, length, key, 0, 0, i, m, p, left, right)
                    else:
                        second = xxhash.xxh64_intdigest(t[p : p + core])
                        for k, whole, also, a, le, ri in _narrower(key, second, left, right, reach, step):
                            out.add(True, step, length, k, whole, also, i, m, p - a, le, ri)
            yield out.batch()

    def widened(reach: int, step: int) -> BatchFunction:
        def run(batches: Batches) -> Batches:
            for b in batches:
                out = _Rows()
                for r in b.to_pylist():
                    for k, whole, also, a, le, ri in _narrower(r["core"], r["second"], r["left"], r["right"], reach, step):
                        out.add(True, step, length, k, whole, also, r["id"], r["mark"], r["place"] - a, le, ri)
                yield out.batch()

        return run

    span = ["id", "mark", "start", "end"]
    found = docs.mapInArrow(places, "core long, whole long, id long, mark long, place long, before short, behind short")
    found = written(_meet(found, crowd).drop("whole", "before", "behind"), "suffix-groups")
    wanted = found.where("way > 0").groupBy("id", "mark").agg(F.collect_list(F.struct("core", "place", "way")).alias("wanted"))
    near = written(docs.join(wanted, ["id", "mark"]).select("id", "mark", "wanted", "text").mapInArrow(surroundings, _Rows.ddl), "suffix-near")
    spans = found.where("start >= 0").select(span).union(_compared(near.where("not wider"), reach, length))
    wider = near.where("wider")
    while True:
        met = written(_meet(wider, crowd, "second long, left binary, right binary"), "suffix-wider")
        spans = spans.union(met.where("start >= 0").select(span))
        if not step:
            return spans
        spans = spans.union(_compared(met.where("way = 1"), step, length))
        less = _less(step, shrink)
        wider, step = met.where("way = 2").mapInArrow(widened(step, less), _Rows.ddl), less


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, core: int = CORE, crowd: int = CROWD, shrink: int = SHRINK) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for each row."""
    null_id = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null_id)).alias("id"), F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).alias("text"))
    # one row for each document: its merged stretches, no more of them than its bytes allow
    spans = written(covered_spans(rows, length=length, core=core, crowd=crowd, shrink=shrink), "suffix-spans").distinct().groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def cut(batches: Batches) -> Batches:
        for b in batches:
            kept, removed, runs = [], [], []
            texts = as_bytes(b.column(2))
            for spans, t in zip(b.column(1).to_pylist(), texts):
                out, last, gone, n = [], 0, 0, 0
                for x in spans or ():
                    a, e = x["start"], x["end"]
                    if a > last or not n:
                        out.append(t[last:a])
                        n += 1
                        gone += e - a
                        last = e
                    elif e > last:
                        gone += e - last
                        last = e
                out.append(t[last:])
                kept.append(b"".join(out))
                removed.append(gone)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, ["id", "mark"], "left").select("id", "spans", "text")
    return joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("id", F.expr(f"nullif(id, {null_id + 1} - 1)"))
