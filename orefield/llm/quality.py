"""Quality classifier from zstandard dictionaries.

Two dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is
compressed with each, in blocks of BLOCK bytes; the normalised size difference says which dictionary knows it better. A
logistic curve fitted on labelled rows the dictionaries have not seen turns the difference, together
with the two compressed shares themselves, into a calibrated score.

Only model fitting uses a bounded sample: at most sample_per_class labelled rows of each class, taken
in the order of a hash of the id, and at most sample_bytes of their texts, half for each class. Scoring covers each whole text. Null texts count as empty; the
empty text has a score like any other. If a class has no labelled row, every score is the share of good labels
(0.5 without labels). Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import with_text_columns

SAMPLE_PER_CLASS = 2000
SAMPLE_BYTES = 64 << 20
DICTIONARY_BYTES = 112 * 1024
LEVEL = 3
BLOCK = 2048
_PIECE = 4000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def _size(text: bytes, tool: zstandard.ZstdCompressor) -> int:
    """Compressed bytes of the whole text, block by block: a long text must not look repetitive for its length alone."""
    return sum(len(tool.compress(text[i : i + BLOCK])) for i in range(0, len(text) or 1, BLOCK))


def _features(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    sizes = np.array([(len(t), _size(t, good), _size(t, bad)) for t in texts], float).reshape(-1, 3)
    n, a, b = sizes.T
    diff, x, y = (b - a) / (a + b), np.minimum(a / (n + 1), 1.5), np.minimum(b / (n + 1), 1.5)
    return np.stack([diff, x, y, diff * x, x * x, diff * np.abs(diff)], axis=1)


def fit(good: list[bytes], bad: list[bytes], prior: float | None = None) -> Model:
    """Dictionaries from one half of each class, calibration from the other half (from the same row where a class has one only)."""
    share = prior if prior is not None else (len(good) / (len(good) + len(bad)) if good or bad else 0.5)
    if not good or not bad:
        return Model(b"", b"", (), (), (), share)
    pieces = [[t[i : i + _PIECE] for t in own[::2] for i in range(0, len(t), _PIECE)] for own in (good, bad)]
    made = []
    for own in pieces:
        try:
            made.append(zstandard.train_dictionary(DICTIONARY_BYTES, own).as_bytes())
        except zstandard.ZstdError:  # too little text: the text itself serves
            made.append(b"\n".join(own)[-DICTIONARY_BYTES:] or b"\n" * 8)
    tools = [_compressor(x) for x in made]
    rest = [good[1::2] or good, bad[1::2] or bad]
    x = np.concatenate([_features(own, *tools) for own in rest])
    y = np.repeat([1.0, 0.0], [len(own) for own in rest])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.r_[1e-6, np.full(z.shape[1] - 1, 1.0)]

    def loss(v: np.ndarray) -> float:
        u = z @ v
        return float((weight * (np.logaddexp(0, u) - y * u)).sum() + 0.5 * (ridge * v * v).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-7:
            break
    return Model(*made, tuple(mean), tuple(scale), tuple(w), share)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[bytes], float | None]:
    """Bounded training texts of each class and the share of good labels; remainder 2 of crc32(id) mod 4 is held out.

    An id is taken with all its rows, or, where they exceed what is left of the class's half of sample_bytes, not at all.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_per_class)
        picked = part if picked is None else picked.union(part)
    # at most 2 x sample_per_class ids are broadcast, and as many sizes reach the driver before any text does
    own = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    rows = own.join(F.broadcast(picked.dropDuplicates(["label_id"])), "label_id")
    sizes = rows.groupBy("label_id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).orderBy(F.xxhash64("label_id"), "label_id").collect()
    left, taken = {0: sample_bytes // 2, 1: sample_bytes // 2}, []
    for r in sizes:
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            taken.append((r["label_id"], r["y"]))
    chosen = docs.sparkSession.createDataFrame(taken, picked.schema)
    texts = own.join(F.broadcast(chosen), "label_id").select("y", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), F.xxhash64("label_id").alias("order")).orderBy("order", "text").collect()
    total = sum(counts.values())
    return [bytes(r["text"]) for r in texts if r["y"] == 1], [bytes(r["text"]) for r in texts if r["y"] == 0], counts.get(1, 0) / total if total else None


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column."""

    tools: list[zstandard.ZstdCompressor] = []

    def run(texts: list[bytes]) -> list[pa.Array]:
        if not model.weights or not texts:
            return [pa.array([model.prior] * len(texts), pa.float64())]
        if not tools:
            tools.extend([_compressor(model.good), _compressor(model.bad)])
        x = (_features(texts, *tools) - np.array(model.mean)) / np.array(model.scale)
        return [pa.array(1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ np.array(model.weights), -40, 40))))]

    return with_text_columns(docs, text_col, f"`{score_col}` double", run)


def train(docs: DataFrame, labels: DataFrame, **names) -> Model:
    good, bad, prior = labelled_sample(docs, labels, **names)
    return fit(good, bad, prior)
