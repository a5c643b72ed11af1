"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer.

The transducer reads bytes. Its transitions carry the change in the number of emitted tokens (a longer
prefix can need fewer tokens, so the change may be negative), and its states hold all that later
bytes can depend on:
  - the place in the pre-tokenizer (inside letters, digits, marks, white space, after an apostrophe),
  - the undecided bytes (half a character; the last white space, which may join the next word;
    an apostrophe that may begin a contraction),
  - for the current pre-token, the byte suffix that a vocabulary entry can still extend, with the last
    token and the relative count at each place inside that suffix. Byte-pair encoding has the prefix
    property: the encoding of a prefix is that of a shorter prefix plus one last token, and the last token is
    the only suffix entry that pairs with the token before it. So these are enough.
States are determinised when first met and kept in a table (state x byte) of at most MAX_STATES states
and those in use; a full table is emptied between two bytes.

Texts are cut into chunks. A chunk's state map is held for the entry states that can matter: the initial
state, from which all chunks of a batch run side by side, and every exit of the map before it. The closed
maps compose by a parallel prefix scan (doubling). Most chunks begin at a cut where any state flushes to the
initial one, and states forget what came before within a few tokens, so maps have one or two entries.

Null texts and empty texts have no tokens. Special strings in a text count as the library counts
them by default: one token each, and the text beside them is split there. Extra columns stay,
but for those with the names of outputs, which replace them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import with_text_columns

CHUNK = 1024
MAX_STATES = 300_000
_END = 256
_LETTER, _DIGIT, _MARK, _SPACE = "L", "N", "P", "S"
#: The contractions of the pre-tokenizer's pattern.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes each byte as a visible character: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str, max_states: int = MAX_STATES) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        self.rank = {}
        for n, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[plain(a), plain(b)] = n
        self.entries = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.prefixes = {e[:i] for e in self.entries for i in range(len(e))}
        self.specials = sorted((t["content"].encode() for t in model["added_tokens"]), key=len, reverse=True)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes: dict[str, str] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.singles: dict[bytes, bool] = {}
        self.max_states = self.most_states = max_states
        self._reset()

    def _reset(self) -> None:
        self.start = ("", b"", b"", ())
        self.numbers = {self.start: 0}
        self.states = [self.start]
        self.column = np.full(257, -1, np.int64)  # symbols get a column when first seen
        self.column[_END] = 0
        self.symbols = [_END]
        self.next = np.full((1024, 64), -1, np.int32)
        self.change = np.zeros((1024, 64), np.int8)

    def _columns_for(self, data: np.ndarray) -> None:
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[b] < 0:
                self.column[b] = len(self.symbols)
                self.symbols.append(b)
        if len(self.symbols) > self.next.shape[1]:
            more = min(257, len(self.symbols) + 32) - self.next.shape[1]
            self.next = np.pad(self.next, ((0, 0), (0, more)), constant_values=-1)
            self.change = np.pad(self.change, ((0, 0), (0, more)))

    # --- byte-pair encoding -------------------------------------------------

    def _merged(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            n, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if n == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pairs_with(self, a: bytes, b: bytes) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > 300_000:
                self.pairs = {}
            self.pairs[a, b] = self._merged(a + b) == [a, b]
        return self.pairs[a, b]

    def _alone(self, a: bytes) -> bool:
        if a not in self.singles:
            self.singles[a] = self._merged(a) == [a]
        return self.singles[a]

    def _push(self, tail: bytes, known: tuple, byte: bytes) -> tuple[bytes, tuple, int]:
        """One byte more in the pre-token. known: (last token, count relative to now) for the places before each byte of tail and now."""
        text = tail + byte
        last, count = b"", 0
        for i in range(len(text)):  # longest entry first
            entry = text[i:]
            if entry not in self.entries:
                continue
            if known[i] is None:
                continue
            before, n = known[i]
            if self._pairs_with(before, entry) if before else self._alone(entry):
                last, count = entry, n + 1
                break
        cut = next(i for i in range(len(text) + 1) if text[i:] in self.prefixes)
        places = [x and (x[0], x[1] - count) for x in (*known, (last, count))]
        rest = text[cut:]
        # a place from which no entry can go on is forgotten, so that states differ only where it matters
        return rest, tuple(x if i == len(rest) or rest[i:] in self.prefixes else None for i, x in enumerate(places[cut:])), count

    # --- transitions ----------------------------------------------------------

    def _class(self, char: str) -> str:
        if char not in self.classes:
            joins = lambda with_: len(self.split(with_ + char)) == 1  # noqa: E731  the library itself says which run a character continues
            self.classes[char] = _LETTER if joins("a") else _DIGIT if joins("1") else _MARK if joins("!") else _SPACE
        return self.classes[char]

    def _bytes(self, tail: bytes, known: tuple, raw: bytes) -> tuple[bytes, tuple, int]:
        total = 0
        for i in range(len(raw)):
            tail, known, n = self._push(tail, known, raw[i : i + 1])
            total += n
        return tail, known, total

    def _transition(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """state: (mode, undecided bytes, suffix, places). Modes: "" between pre-tokens, a class, a quote and what follows it."""
        mode, held, tail, known = state
        fresh = ((b"", 0),)
        if byte == _END:
            if mode == _SPACE:
                _, _, n = self._bytes(tail, known, held)
                return self.start, n
            if mode[:1] == "'":
                return self._flush_quote(mode)
            return self.start, 0
        half = b""
        if mode[-1:] == "~":  # inside a character of several bytes
            mode, n_held = mode[:-2], int(mode[-2])
            held, half = held[:n_held], held[n_held:]
        half += bytes([byte])
        if byte >= 0x80:
            need = 2 if half[0] < 0xE0 else 3 if half[0] < 0xF0 else 4
            if len(half) < need:
                return (f"{mode}{len(held)}~", held + half, tail, known), 0
        return self._character(mode, held, tail, known, half, fresh)

    def _flush_quote(self, mode: str) -> tuple[tuple, int]:
        total = self._bytes(b"", ((b"", 0),), b"'")[2]
        if len(mode) > 1:
            total += self._bytes(b"", ((b"", 0),), mode[1:].encode())[2]
        return self.start, total

    def _character(self, mode: str, held: bytes, tail: bytes, known: tuple, raw: bytes, fresh: tuple) -> tuple[tuple, int]:
        char = raw.decode()
        kind = self._class(char)
        total = 0
        if mode[:1] == "'":
            grown = mode[1:] + char
            if grown in _CONTRACTIONS:
                return self.start, self._bytes(b"", fresh, b"'" + grown.encode())[2]
            if any(c.startswith(grown) for c in _CONTRACTIONS):
                return ("'" + grown, b"", b"", ()), 0
            if len(mode) == 1 and kind == _MARK:
                tail, known, total = self._bytes(b"", fresh, b"'" + raw)
                return (_MARK, b"", tail, known), total
            # the quote stands alone; a letter after it begins a word that this character may continue
            total = self._bytes(b"", fresh, b"'")[2]
            mode, tail, known = "", b"", ()
            if len(grown) > 1:
                tail, known, n = self._bytes(b"", fresh, grown[:-1].encode())
                mode, total = _LETTER, total + n
        if mode == _SPACE:
            if kind == _SPACE:
                tail, known, n = self._bytes(tail, known or fresh, held)
                return (_SPACE, raw, tail, known), n
            if held == b" ":
                tail, known, n = self._bytes(b"", fresh, held + raw)
                return (kind, b"", tail, known), n
            total = self._bytes(b"", fresh, held)[2]
            mode = ""
        if kind == _SPACE:
            return (_SPACE, raw, b"", fresh), total
        if kind == mode:
            tail, known, n = self._bytes(tail, known, raw)
            return (kind, b"", tail, known), total + n
        if char == "'":
            return ("'", b"", b"", ()), total
        tail, known, n = self._bytes(b"", fresh, raw)
        return (kind, b"", tail, known), total + n

    def _learn(self, state: int, byte: int) -> None:
        target, change = self._transition(self.states[state], byte)
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
            if number >= len(self.next):
                grow = min(len(self.next), 16384)
                self.next = np.concatenate([self.next, np.full((grow, self.next.shape[1]), -1, np.int32)])
                self.change = np.concatenate([self.change, np.zeros((grow, self.next.shape[1]), np.int8)])
        self.next[state, self.column[byte]] = number
        self.change[state, self.column[byte]] = change

    # --- running chunks side by side ------------------------------------------

    def run(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray, flush: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, count) of each chunk data[begin:end] from its entry state; chunks with flush end their pre-token.

        held: further arrays of state numbers in use. They and entry are renumbered in place when the table is emptied.
        """
        order = np.argsort(begin - end, kind="stable")
        at, stop, state = begin[order].copy(), end[order], entry[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        live = len(order)
        while True:
            while live and at[live - 1] >= stop[live - 1]:
                live -= 1
            if not live:
                break
            self._step(state[:live], data[at[:live]], count[:live])
            at[:live] += 1
            if len(self.states) > self.most_states:
                self._forget([state, entry, *held])
        final = flush[order]
        if final.any():
            s, c = state[final], count[final]
            self._step(s, np.full(len(s), _END), c)
            state[final], count[final] = s, c
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def _forget(self, held: list[np.ndarray]) -> None:
        """Empties the table but for the initial state and those of held, which are renumbered. Twice as many stay free at least."""
        known, states = np.unique(np.concatenate([[0], *held])), self.states
        self.numbers = {states[s]: n for n, s in enumerate(known.tolist())}
        self.states = list(self.numbers)
        self.most_states = max(self.max_states, 3 * len(known))
        rows = max(1024, len(known))
        self.next = np.full((rows, self.next.shape[1]), -1, np.int32)
        self.change = np.zeros((rows, self.next.shape[1]), np.int8)
        for own in held:
            own[:] = np.searchsorted(known, own)

    def _step(self, state: np.ndarray, symbols: np.ndarray, count: np.ndarray) -> None:
        width = self.next.shape[1]
        place = state * width + self.column[symbols]
        following = self.next.ravel()[place]
        if following.min() < 0:
            for p in np.unique(place[following < 0]).tolist():
                self._learn(p // width, self.symbols[p % width])
            following = self.next.ravel()[place]
        count += self.change.ravel()[place]
        state[:] = following

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        parts: list[tuple[int, bytes]] = []
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.specials:
                if special in text:
                    pieces = [x for piece in pieces for x in piece.split(special)]
                    extra[i] += len(pieces) - 1
            parts += [(i, p) for p in pieces if p]
        if not parts:
            return extra
        data = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        self._columns_for(data)
        ends = np.cumsum([len(p) for _, p in parts])
        begins = np.concatenate([[0], ends[:-1]])
        # a cut before a space that follows a visible ASCII character: whatever came before, a pre-token begins there
        safe = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
        heads, tails, owner, first, flush = [], [], [], [], []
        for n, (b, e) in enumerate(zip(begins.tolist(), ends.tolist())):
            cuts, clean = [b], [True]
            while e - cuts[-1] > 2 * CHUNK:
                want = cuts[-1] + CHUNK
                j = int(np.searchsorted(safe, want))
                if j < len(safe) and safe[j] < min(e, want + CHUNK):
                    cuts.append(int(safe[j]))
                    clean.append(True)
                else:
                    while data[want] & 0xC0 == 0x80:  # not inside a character
                        want -= 1
                    cuts.append(want)
                    clean.append(False)
            heads += cuts
            tails += [*cuts[1:], e]
            owner += [parts[n][0]] * len(cuts)
            first += clean
            flush += [*clean[1:], True]
        np.add.at(extra, np.array(owner)[np.array(first)], self._composed(data, np.array(heads), np.array(tails), np.array(first), np.array(flush)))
        return extra

    def _composed(self, data: np.ndarray, head: np.ndarray, tail: np.ndarray, free: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Tokens from each chunk that begins free of what came before (entry: the initial state) up to the chunk that ends with a flush.

        The state maps are one table of rows (chunk, entry, exit, count). Each map holds the initial state and all
        exits of the map before, so a chunk's row leads to one row of the next chunk, and maps compose by doubling:
        after step d a row holds the count of 2^d chunks and leads to the row behind them.
        """
        n = len(head)
        chunk, entry = np.arange(n), np.zeros(n, np.int64)
        exits, count = self.run(data, head, tail, entry, final, [])
        new = np.arange(n)
        while True:  # close the maps: exits that the next map does not hold become entries of it
            onward = new[~final[chunk[new]]]
            asked = np.unique(np.stack([chunk[onward] + 1, exits[onward]], 1), axis=0)
            asked = asked[~np.isin(self._key(asked[:, 0], asked[:, 1]), self._key(chunk, entry))]
            if not len(asked):
                break
            more, into = asked.T[0], asked.T[1].copy()
            out, c = self.run(data, head[more], tail[more], into, final[more], [entry, exits])
            new = np.arange(len(chunk), len(chunk) + len(more))
            chunk, entry, exits, count = (np.concatenate(x) for x in ((chunk, more), (entry, into), (exits, out), (count, c)))
        order = np.argsort(self._key(chunk, entry))
        chunk, entry, exits, total = chunk[order], entry[order], exits[order], count[order]
        goes = ~final[chunk]
        behind = np.searchsorted(self._key(chunk, entry), self._key(chunk + 1, exits))
        behind = np.append(np.where(goes, behind, len(chunk)), len(chunk))
        total = np.append(total, 0)
        while (behind[:-1] < len(chunk)).any():
            total, behind = total + total[behind], behind[behind]
        return total[:-1][(entry == 0) & free[chunk]]

    @staticmethod
    def _key(chunk: np.ndarray, state: np.ndarray) -> np.ndarray:
        return chunk.astype(np.int64) << 32 | state


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer_of(path: str) -> Transducer:
    """One transducer for each worker process: what it has determinised outlives a task."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def token_counts(docs: DataFrame, tokenizer: str, *, text_col: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than limit tokens)."""
    def run(texts: list[bytes]) -> list[pa.Array]:
        made = transducer_of(tokenizer)
        n = np.concatenate([made.counts(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]) if texts else np.zeros(0, np.int64)
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]

    return with_text_columns(docs, text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean", run)
