"""Token-id files: a shared zstandard dictionary and one frame per document.

File format. A store is a set of blocks of consecutive documents (ascending id), one Parquet row each
so that any store Spark writes to will do and a lost task is simply written again:
  bucket, block      place of the block in id order
  first              ids in the bucket before this block
  dictionary_sha256  hash of the shared dictionary; a reader refuses another one
  doc_ids            ids of its documents, in order
  counts             tokens of each document
  ends               end of each document's frame in payload (the offset index)
  payload            zstandard frames, one for each document, of little-endian unsigned 16- or 32-bit ids
Any short document is read through its index entry alone, without the frames beside it.

Texts are encoded where they are scanned; only compressed frames are shuffled, by ranges of ids. An id
with more rows than a range holds is spread over several ranges.

The tokenizer library encodes each distinct piece between white space once per worker's memo;
pieces do not depend on one another, since its pre-tokenizer never joins across white space. Pieces of Latin
letters, digits and ASCII signs go straight to the library's model, run by run, if probes show that its other steps leave them as they are.
The dictionary is trained on a bounded sample (dictionary_docs documents, in the order of a hash of their ids, up to
dictionary_text_bytes of text); it changes sizes, never ids.

Null texts count as empty; an empty text holds the end id alone. Rows with a null id are kept, first
in order. Repeated ids keep a row each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Batches, as_bytes, slices, written

END_ID = 1
DICTIONARY_BYTES = 64 * 1024
DICTIONARY_DOCS = 256
DICTIONARY_TEXT_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
LEVEL = 1
_MEMO_PIECES = 300_000
_ASKED = 2000
_PART_BYTES = 4 << 20
_SAMPLE_BYTES = 16_384
_NULL_ID = -(1 << 63)
_BLOCK_DDL = "bucket int, block int, first long, dictionary_sha256 string, doc_ids array<bigint>, counts array<bigint>, ends array<bigint>, payload binary"
_BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
_STOPS = re.compile(rb"[.,](?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))(?![^\x20\x09-\x0d])")
#: Plain pieces: lower-case Latin letters (ASCII and U+00DF to U+00FF without the division sign), digits and ASCII signs but the apostrophe.
_RUNS = re.compile(rb"(?:[a-z]+|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_ASCII_PLAIN = bytes(b for b in range(33, 127) if b != 39 and not 65 <= b <= 90)
_LATIN = re.compile(rb"(?:\xc3[\x9f-\xb6\xb8-\xbf])*+")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, the rest follow from U+0100. The space, which parts runs here, stays."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others) if b != 32}


class Encoder:
    """Ids of whole texts by the tokenizers library, with a memo of pieces in two bounded generations."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = Tokenizer.from_file(path)  # the same model, for runs that its first steps leave as they are
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[n for word, n in vocabulary.items() if word.endswith("</w>")]] = True
        self.stand_in = _byte_characters()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.lowers = self._library(b"Ab, Cd.") == self._library(b"ab , cd .")
        probes = "the anthropology, qx ß éçö naïve ÿ 2047 a1b2 $$$ *** (a) x-y_z {|} <= == ... ,; th.re the$ $the 12ab ab12 zzzqqq".encode().split()
        self.direct = self.lowers and self.word_end.any() and self._by_model(probes) == [self._library(p) for p in probes]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.memo) > _MEMO_PIECES:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        words = pc.ascii_split_whitespace(pa.array([self._parted(t) for t in texts], pa.large_binary()).cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()  # each distinct piece of these texts is looked up once
        pieces = coded.dictionary.cast(pa.large_binary()).to_pylist()
        missing = [p for p in pieces if p not in memo]
        known = {p: old[p] for p in missing if p in old}
        memo.update(known)
        missing = [p for p in missing if p not in known]
        plain = [p for p in missing if p and b"<|" not in p and _LATIN.fullmatch(p.translate(None, _ASCII_PLAIN))] if self.direct else []
        for i in range(0, len(plain), _ASKED):  # the library's results are large: a few pieces at a time
            part = plain[i : i + _ASKED]
            memo.update(zip(part, self._by_model(part)))
        memo.update((p, self._library(p)) for p in set(missing).difference(plain))
        found = list(map(memo.__getitem__, pieces))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        own = lengths[codes]
        ends = np.cumsum(own)
        ids = flat[np.repeat(begins[codes] - (ends - own), own) + np.arange(own.sum())]
        cuts = np.concatenate([[0], ends])[words.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _parted(self, text: bytes) -> bytes:
        """Where the normaliser lowers case: lowered, with a full stop or comma at a word's end apart, as it will be anyway."""
        return _STOPS.sub(rb" \g<0>", text.lower()) if self.lowers and b"<|" not in text else text

    def _library(self, piece: bytes) -> bytes:
        return np.array(self.library.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _by_model(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of plain pieces: their runs in one text, each ending with the one id that says so."""
        runs = [[p] if p.isalpha() else _RUNS.findall(p) for p in pieces]
        shown = (b" ".join(r) for r in runs)
        text = " ".join(r.decode() if r.isascii() else r.decode("latin-1").translate(self.stand_in) for r in shown)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        last = np.cumsum([len(r) for r in runs])
        if not len(ends) or len(ends) != last[-1]:
            raise ValueError("the tokenizer's model does not end each run with one id")
        raw, cuts = ids.tobytes(), [0, *(4 * ends[last - 1]).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that its memo outlives a task."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", dictionary_docs: int = DICTIONARY_DOCS, dictionary_text_bytes: int = DICTIONARY_TEXT_BYTES) -> bytes:
    """A dictionary from the whole id arrays of at most dictionary_docs documents, the first by a hash of id that fit into dictionary_text_bytes."""
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size")).where("id is not null")
    first = sized.orderBy(F.xxhash64("id"), "id", "size").limit(dictionary_docs).collect()
    total, wanted = 0, set()
    for r in first:
        if total + r["size"] <= dictionary_text_bytes:
            total += r["size"]
            wanted.add(r["id"])
    if not wanted:
        return b"\0" * 8
    rows = docs.where(F.col(id_col).cast("long").isin(*wanted)).where(F.octet_length(text_col) <= max(r["size"] for r in first)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = [(r["text"] or "").encode() for r in rows.orderBy("id", "text").limit(dictionary_docs).collect()]
    arrays = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in Encoder(tokenizer).encode(found)]
    samples = [x[i : i + _SAMPLE_BYTES] for x in arrays for i in range(0, len(x), _SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or b"\0" * 8)[-DICTIONARY_BYTES:]


def _places(ids: np.ndarray, frames: list[bytes], cuts: np.ndarray) -> np.ndarray:
    """The range of each id; one that fills several ranges is spread over them by its frames."""
    low, high = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    for i in np.flatnonzero(high - low >= 2):
        high[i] = low[i] + zlib.crc32(frames[i]) % (high[i] - low[i] + 1)
    return high.astype(np.int32)


def write(docs: DataFrame, tokenizer: str, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, buckets: int | None = None) -> tuple[DataFrame, bytes]:
    """Encode, write the store in ascending id order (under path, or in the shared folder); its block table and dictionary."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, id_col=id_col, text_col=text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    n = buckets or 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.array((rows.select(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10000)).first()[0] or []) if n > 1 else [], np.int64)

    def framed(batches: Batches) -> Batches:
        encoder = encoder_of(tokenizer)
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for b in slices(batch, 1, _PART_BYTES):
                frames, counts = [], []
                for raw in encoder.encode(as_bytes(b.column(1))):
                    ids = np.frombuffer(raw + end, "<u4")
                    narrow = ids.max() < 65536
                    counts.append(len(ids))
                    frames.append((b"\2" if narrow else b"\4") + packer.compress(ids.astype("<u2").tobytes() if narrow else raw + end))
                bucket = _places(b.column(0).to_numpy(), frames, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["bucket", "id", "n", "frame"])

    def blocked(batches: Batches) -> Batches:
        held: list[tuple] = []
        last, block, first = None, 0, 0

        def made() -> pa.RecordBatch:
            ids, counts, frames = zip(*held)
            ids = [None if x == _NULL_ID else x for x in ids]
            values = {"bucket": [last], "block": [block], "first": [first], "dictionary_sha256": [digest], "doc_ids": [ids], "counts": [counts], "ends": [np.cumsum([len(x) for x in frames]).tolist()], "payload": [b"".join(frames)]}
            return pa.RecordBatch.from_pydict(values, schema=_BLOCK)

        size = 0
        for b in batches:
            for where, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (where != last or size >= BLOCK_BYTES):
                    yield made()
                    block, first, size, held = block + 1, first + sum(x[1] for x in held), 0, []
                if where != last:
                    last, block, first = where, 0, 0
                held.append(tuple(row))
                size += len(row[2])
        if held:
            yield made()

    frames = rows.mapInArrow(framed, "bucket int, id long, n long, frame binary")
    ordered = frames.repartition(max(1, n // 4), "bucket").sortWithinPartitions("bucket", "id", "n", "frame")
    blocks = ordered.mapInArrow(blocked, _BLOCK_DDL)
    if path is None:
        return written(blocks, "token-store"), dictionary
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path), dictionary


def read(blocks: DataFrame, dictionary: bytes, *, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids binary, ids_crc32): each document's ids read back, start being the ids of all documents before it. Without with_ids, ids is null."""
    digest = hashlib.sha256(dictionary).hexdigest()
    per_bucket = blocks.groupBy("bucket").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    sizes = dict(per_bucket.collect())  # one number for each bucket: as many as the writer was given
    numbers = sorted(sizes)
    begins = dict(zip(numbers, np.cumsum([0, *(sizes[b] for b in numbers)]).tolist()))

    def run(batches: Batches) -> Batches:
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("the store was written with another dictionary")
                begin, out, counts, sums = 0, [], [], []
                for end in row["ends"]:
                    frame = row["payload"][begin:end]
                    ids = np.frombuffer(reader.decompress(frame[1:]), "<u2" if frame[:1] == b"\2" else "<u4").astype("<u4").tobytes()
                    counts.append(len(ids) // 4)
                    sums.append(zlib.crc32(ids))
                    out.append(ids if with_ids else None)
                    begin = end
                if counts != row["counts"]:
                    raise ValueError("a frame does not hold the ids that its index says")
                starts = begins[row["bucket"]] + row["first"] + np.cumsum([0, *counts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary()), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids", "ids_crc32"])

    return blocks.mapInArrow(run, "id long, start long, n_tokens long, ids binary, ids_crc32 long")
