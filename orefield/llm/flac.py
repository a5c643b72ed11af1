"""FLAC media columns: lossless 8-bit mono audio in a binary column, coded and decoded here with numpy.

Coding: each frame of BLOCK samples takes the cheapest of constant, verbatim, fixed linear predictors
(order 0 to 2) and, with lpc=True, a quantised linear predictor of order LPC_ORDER (slower, a little smaller),
with Rice-coded residuals. STREAMINFO holds the
MD5 of the samples, a SEEKTABLE the sample number and byte offset of every frame.

Decoding: frame headers are read, header CRC-8, frame CRC-16 and the MD5 are verified, and the frames of a
batch are decoded side by side, one lane a frame: unary quotients through a table of the next one-bit,
then the predictor's recursion. Result rows are PCM blocks with their first sample, so a
reader can begin at any block (seek).

Nulls count as empty; empty and null payloads give one block of padding. Repeated rows code alike; extra
columns stay, but for those with the names of outputs, which replace them. Damaged media raise ValueError naming the check that failed.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import with_text_columns

BLOCK = 4096
RATE = 8000
LPC_ORDER = 4
LPC_PRECISION = 8
LPC_SHIFT = 6
_HIGHEST_RICE = 14
_PART = 1 << 20
#: Samples that are decoded at a time: a step of the recursion is one for all frames, so more frames share its cost.
_SIDE_BY_SIDE = 3 << 20


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return out


_CRC8 = _crc_table(0x07, 8)
_CRC16 = np.array(_crc_table(0x8005, 16), np.uint32)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


class _Crc16:
    """CRC-16 of many byte runs at once: a byte's share depends only on its distance to the end of its run."""

    def __init__(self) -> None:
        self.shares = _CRC16[None, :].copy()  # row d: share of a byte with d bytes after it

    def of(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        while len(self.shares) < size.max():
            rows = [self.shares[-1]]
            for _ in range(1024):
                c = rows[-1]
                rows.append(((c << 8) & 0xFFFF) ^ _CRC16[c >> 8])
            self.shares = np.concatenate([self.shares, np.stack(rows[1:])])
        ends = np.cumsum(size)
        starts = ends - size
        order = np.arange(ends[-1]) - np.repeat(starts, size)
        byte = data[np.repeat(begin, size) + order]
        share = self.shares.ravel()[(np.repeat(size, size) - 1 - order) * 256 + byte]
        return np.bitwise_xor.reduceat(share, starts)


_crc16 = _Crc16()


def _coded_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    first = (0xFF00 >> size & 0xFF) | n >> (6 * (size - 1))
    return bytes([first, *(0x80 | n >> (6 * i) & 0x3F for i in range(size - 2, -1, -1))])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for i in range(width):
        bits[at + i] = value >> (width - 1 - i) & 1


def _lpc(x: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each frame (Levinson-Durbin on the autocorrelation), frames x LPC_ORDER."""
    f = x.astype(np.float64)
    auto = [np.add.reduceat(f * f, starts)]
    for lag in range(1, LPC_ORDER + 1):
        product = np.zeros_like(f)
        product[lag:] = np.where(place[lag:] >= lag, f[lag:] * f[:-lag], 0)
        auto.append(np.add.reduceat(product, starts))
    error = auto[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(starts), LPC_ORDER))
    for i in range(LPC_ORDER):
        acc = auto[i + 1] - sum((a[:, j] * auto[i - j] for j in range(i)), np.zeros(len(starts)))
        k = np.clip(acc / error, -0.999999, 0.999999)
        before = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        error = error * (1 - k * k)
    limit = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -limit - 1, limit).astype(np.int64)


def encode(payloads: list[bytes], block: int = BLOCK, lpc: bool = False) -> list[bytes]:
    """A FLAC file for each payload of unsigned bytes (as signed samples: byte - 128). Payloads must not be empty.

    Frames are coded about _PART samples at a time, several payloads or a part of one, so working memory does not follow a payload's length.
    """
    files: list[tuple[list[bytes], list[int]]] = [([], []) for _ in payloads]
    part: list[tuple[int, int, bytes]] = []  # owner, number of the first frame, samples
    size = 0

    def code() -> None:
        for (owner, _, _), (body, stored) in zip(part, _code_frames([(first, p) for _, first, p in part], block, lpc)):
            files[owner][0].append(body)
            files[owner][1].extend(stored)
        part.clear()

    step = max(1, _PART // block) * block
    for owner, p in enumerate(payloads):
        for at in range(0, len(p), step):
            piece = p[at : at + step]
            part.append((owner, at // block, piece))
            size += len(piece)
            if size >= _PART:
                code()
                size = 0
    if part:
        code()
    return [_file(p, block, bodies, stored) for p, (bodies, stored) in zip(payloads, files)]


def _file(payload: bytes, block: int, bodies: list[bytes], stored: list[int]) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE before the frames."""
    md5 = hashlib.md5(usedforsecurity=False)
    for at in range(0, len(payload), _PART):
        md5.update((np.frombuffer(payload, np.uint8, min(_PART, len(payload) - at), at) ^ 0x80).tobytes())
    info = struct.pack(">HH", block, block) + min(stored).to_bytes(3) + max(stored).to_bytes(3) + (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + md5.digest()
    offsets = np.cumsum(stored) - stored
    table = b"".join(struct.pack(">QQH", block * k, int(o), min(block, len(payload) - block * k)) for k, o in enumerate(offsets))
    return b"".join([b"fLaC", b"\x00", len(info).to_bytes(3), info, b"\x83", len(table).to_bytes(3), table, *bodies])


def _code_frames(pieces: list[tuple[int, bytes]], block: int, with_lpc: bool) -> list[tuple[bytes, list[int]]]:
    """(coded frames, size of each) of each piece, which is the number of its first frame and its samples."""
    payloads = [p for _, p in pieces]
    sizes = np.array([len(p) for p in payloads])
    per = -(-sizes // block)
    owner = np.repeat(np.arange(len(payloads)), per)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    number = within + np.array([first for first, _ in pieces])[owner]
    n = np.minimum(block, sizes[owner] - within * block)
    starts = np.cumsum(n) - n
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    frame = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(x)) - np.repeat(starts, n)
    first_order = np.diff(x, prepend=x[:1])
    residuals = [x, first_order, np.diff(first_order, prepend=first_order[:1])]
    coefficient = np.zeros((len(n), LPC_ORDER), np.int64)
    if with_lpc:
        coefficient = _lpc(x, place, starts)
        predicted = sum(coefficient[frame, j] * np.concatenate([np.zeros(j + 1, np.int32), x[: len(x) - j - 1]])[: len(x)] for j in range(LPC_ORDER)) >> LPC_SHIFT
        residuals.append((x - predicted).astype(np.int32))
    orders = np.array([0, 1, 2, LPC_ORDER])
    extra = np.array([0, 0, 0, 9 + LPC_ORDER * LPC_PRECISION])
    best = np.full(len(n), 8, np.int64) + 8 * n  # verbatim
    kind, rice = np.full(len(n), 4), np.zeros(len(n), np.int64)
    folded = []
    for m, r in enumerate(residuals):
        u = (r << 1) ^ (r >> 31)
        for warm in range(orders[m]):
            u[(starts + warm)[n > warm]] = 0
        folded.append(u)
        many = np.maximum(n - orders[m], 1)
        middle = np.floor(np.log2(np.maximum(np.add.reduceat(u, starts, dtype=np.int64) / many * 0.7, 1))).astype(np.int64)
        for k in (middle, middle + 1):
            k = np.clip(k, 0, _HIGHEST_RICE)
            bits = np.add.reduceat(u >> np.repeat(k.astype(np.int32), n), starts, dtype=np.int64) + many * (k + 1) + 8 + 8 * orders[m] + 10 + extra[m]
            better = (bits < best) & (n > orders[m])
            best, kind, rice = np.where(better, bits, best), np.where(better, m, kind), np.where(better, k, rice)
    same = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    kind = np.where(same, 5, kind)
    order = np.array([0, 1, 2, LPC_ORDER, 0, 0])[kind]
    u = folded[0]
    for m in range(1, len(folded)):
        u = np.where(np.repeat(kind == m, n), folded[m], u)
    kind_of = np.repeat(kind, n)
    coded = (kind_of < 4) & (place >= np.repeat(order, n))
    k = np.repeat(rice.astype(np.int32), n)
    length = np.where(coded, (u >> k) + (1 + k), 0)
    total = np.cumsum(length, dtype=np.int64)
    body = np.add.reduceat(length, starts, dtype=np.int64)
    heads = [b"\xff\xf8\x70\x02" + _coded_number(i) + struct.pack(">H", s - 1) for i, s in zip(number.tolist(), n.tolist())]
    heads = [h + bytes([_crc8(h)]) for h in heads]
    head_size = np.array([len(h) for h in heads])
    fields = np.where(kind == 4, 8 * n, np.where(kind == 5, 8, 8 * order + np.where(kind == 3, 9 + LPC_ORDER * LPC_PRECISION, 0) + 10))
    bits_of = 8 + fields + body
    bytes_of = head_size + -(-bits_of // 8) + 2
    at = np.cumsum(bytes_of) - bytes_of
    bits = np.zeros(int(bytes_of.sum()) * 8, np.uint8)
    sub = (at + head_size) * 8
    _put(bits, sub, np.array([0b001000, 0b001001, 0b001010, 0b100000 + LPC_ORDER - 1, 1, 0])[kind] << 1, 8)
    raw = np.flatnonzero(~coded & ((kind_of != 5) | (place == 0)))
    _put(bits, sub[frame[raw]] + 8 + 8 * place[raw], x[raw] & 0xFF, 8)
    lpc = kind == 3
    where = sub[lpc] + 8 + 8 * LPC_ORDER
    _put(bits, where, np.full(len(where), LPC_PRECISION - 1), 4)
    _put(bits, where + 4, np.full(len(where), LPC_SHIFT), 5)
    for j in range(LPC_ORDER):
        _put(bits, where + 9 + j * LPC_PRECISION, coefficient[lpc, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    has = kind < 4
    first = sub + 8 + fields
    _put(bits, first[has] - 4, rice[has], 4)  # method and partition order before it are zero
    c = np.flatnonzero(coded)
    uc, kc = u[c], k[c]
    # a code ends where the codes before it in its frame and its own length say; the stop bit stands k bits before that
    last = total[c] + np.repeat(first - (np.cumsum(body) - body), n)[c] - 1
    bits[last - kc] = 1
    least = int(kc.min(initial=_HIGHEST_RICE))
    for i in range(int(kc.max(initial=0))):
        if i < least:
            bits[last - i] = uc >> i & 1
        else:
            use = kc > i
            bits[last[use] - i] = uc[use] >> i & 1
    data = np.packbits(bits)
    for h, a in zip(heads, at.tolist()):
        data[a : a + len(h)] = np.frombuffer(h, np.uint8)
    crc = _crc16.of(data, at, bytes_of - 2)
    data[at + bytes_of - 2] = crc >> 8
    data[at + bytes_of - 1] = crc & 0xFF
    last_frame = np.cumsum(per)
    out = []
    for first, end in zip((last_frame - per).tolist(), last_frame.tolist()):
        stored = bytes_of[first:end].tolist()
        out.append((data[int(at[first]) : int(at[first]) + sum(stored)].tobytes(), stored))
    return out


def seek_points(media: bytes) -> tuple[dict, list[tuple[int, int, int]]]:
    """STREAMINFO and (first sample, byte offset in the file, samples) of each frame."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, last, info, points = 4, False, {}, []
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4])
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18])
            info = {"block": int.from_bytes(body[2:4]), "samples": packed & (1 << 36) - 1, "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "md5": body[18:34]}
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
    if (info.get("bits"), info.get("channels")) != (8, 1):
        raise ValueError("only 8-bit mono is held in these columns")
    return info, [(s, at + o, n) for s, o, n in points]


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each file its PCM blocks (first sample, unsigned bytes), all checksums verified.

    Frames are decoded about _SIDE_BY_SIDE samples at a time, of several files or a part of one.
    """
    out: list[list[tuple[int, bytes]]] = [[] for _ in media]
    part: list[tuple[int, int, int, bytes]] = []  # file, first sample, number, coded frame
    samples = 0

    def run() -> None:
        coded = [x[3] for x in part]
        size = np.array([len(x) for x in coded])
        for (owner, first, _, _), pcm in zip(part, _frames(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(size) - size, size, np.array([x[2] for x in part]))):
            out[owner].append((first, pcm))
        part.clear()

    heads = []
    for owner, m in enumerate(media):
        info, points = seek_points(m)
        heads.append(info)
        ends = [*(p[1] for p in points[1:]), len(m)]
        for k, ((first, begin, n), end) in enumerate(zip(points, ends)):
            part.append((owner, first, k, m[begin:end]))
            samples += n
            if samples >= _SIDE_BY_SIDE:
                run()
                samples = 0
    if part:
        run()
    for info, own in zip(heads, out):
        md5 = hashlib.md5(usedforsecurity=False)
        for _, pcm in own:
            md5.update((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes())
        if sum(len(pcm) for _, pcm in own) != info["samples"] or md5.digest() != info["md5"]:
            raise ValueError("samples do not match STREAMINFO")
    return out


def seek(media: bytes, sample: int) -> tuple[int, bytes]:
    """The PCM block that holds a sample, decoded alone: (its first sample, bytes)."""
    _, points = seek_points(media)
    j = max(i for i, p in enumerate(points) if p[0] <= sample)
    end = points[j + 1][1] if j + 1 < len(points) else len(media)
    frame = media[points[j][1] : end]
    return points[j][0], _frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), np.array([points[j][0] // (points[0][2] or 1)]))[0]


def _frames(data: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Unsigned bytes of each frame."""
    crc = _crc16.of(data, begin, size - 2)
    if not np.array_equal(crc, data[begin + size - 2].astype(np.uint32) << 8 | data[begin + size - 1]):
        raise ValueError("frame CRC-16 is wrong")
    n, sub = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
    for j, (b, want) in enumerate(zip(begin.tolist(), number.tolist())):
        coded = _coded_number(want)
        end = b + 4 + len(coded) + 2
        head = data[b : end + 1].tobytes()
        if head[:4] != b"\xff\xf8\x70\x02" or head[4:-3] != coded:
            raise ValueError("frame header is not the expected one")
        if _crc8(head[:-1]) != head[-1]:
            raise ValueError("header CRC-8 is wrong")
        n[j] = int.from_bytes(head[-3:-1]) + 1
        sub[j] = 8 * (end + 1)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]

    def take(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (window[at >> 3].astype(np.int64) >> (32 - (at & 7) - width)) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(at: np.ndarray, width: int) -> np.ndarray:
        v = take(at, width)
        return v - ((v >> (width - 1)) << width)

    kind = take(sub, 8) >> 1
    fixed = (kind & 0b111000) == 0b001000
    lpc = kind >= 32
    order = np.where(lpc, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    if order.max(initial=0) > 8 or not (fixed | lpc | (kind <= 1)).all():
        raise ValueError("subframe type is not supported")
    out = np.zeros((int(n.max()), len(n)), np.int32)  # sample x lane
    column = np.arange(len(n))
    plain = kind == 1
    for t in range(int(n[plain].max(initial=0))):
        live = plain & (n > t)
        out[t, live] = signed(sub[live] + 8 + 8 * t, 8)
    level = kind == 0
    if level.any():
        out[:, level] = signed(sub[level] + 8, 8)
    most = int(order.max(initial=0))
    for t in range(most):
        live = (fixed | lpc) & (order > t)
        out[t, live] = signed(sub[live] + 8 + 8 * t, 8)
    weights = np.zeros((most, len(n)), np.int64)
    shift = np.zeros(len(n), np.int64)
    at = sub + 8 + 8 * order
    if lpc.any():
        precision = take(at, 4) + 1
        shift = np.where(lpc, take(at + 4, 5), 0)
        for j in range(most):
            live = lpc & (order > j)
            v = take(at[live] + 9 + j * precision[live], precision[live])
            weights[j, live] = v - ((v >> (precision[live] - 1)) << precision[live])
        at = at + np.where(lpc, 9 + order * precision, 0)
    coded = fixed | lpc
    if take(at[coded], 6).any():
        raise ValueError("residual coding is not one Rice partition")
    k = np.where(coded, take(at + 6, 4), 0)
    at = at + 10
    following = np.where(np.unpackbits(data), np.arange(8 * len(data), dtype=np.int32), np.int32(8 * len(data) - 1))
    following = np.minimum.accumulate(following[::-1])[::-1]
    lanes = np.flatnonzero(coded)
    lanes = lanes[np.argsort(-n[lanes], kind="stable")]
    if len(lanes):
        sizes, orders = n[lanes], order[lanes]
        p, kk = at[lanes].astype(np.int32), k[lanes].astype(np.int32)
        low, room = (np.int32(1) << kk) - np.int32(1), np.int32(24) - kk
        window = (window >> 8).astype(np.int32)  # 24 bits hold any k low bits
        one, seven, three = np.int32(1), np.int32(7), np.int32(3)
        folded = np.zeros((int(sizes[0]), len(lanes)), np.int32)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist()
        for t, live in enumerate(alive):  # codes: unary quotient, stop bit, k low bits
            q, kl = p[:live], kk[:live]
            stop = following[q]
            behind = stop + one
            value = ((stop - q) << kl) | ((window[behind >> three] >> (room[:live] - (behind & seven))) & low[:live])
            if t < most:
                use = orders[:live] <= t
                folded[t, :live] = np.where(use, value, 0)
                p[:live] = np.where(use, behind + kl, q)
            else:
                folded[t, :live] = value
                np.add(behind, kl, out=q)
        residual = (folded >> 1) ^ -(folded & 1)
        for degree in np.unique(orders[fixed[lanes]]).tolist():  # fixed predictors: sums of the residuals, degree times
            own = fixed[lanes] & (orders == degree)
            x, warm = residual[:, own], out[:degree, lanes[own]]
            differences = [warm]
            for _ in range(1, degree):
                differences.append(np.diff(differences[-1], axis=0))
            for d in range(degree - 1, -1, -1):
                x[d] = differences[d][0] if d < len(differences) and len(differences[d]) else x[d]
                x[d:] = np.cumsum(x[d:], axis=0)
            out[: len(x), lanes[own]] = x
        if lpc.any():
            _predict(out, residual, lanes, weights, shift, lpc, order, alive)
    pcm = (out.T + 128).astype(np.uint8)
    return [pcm[j, : n[j]].tobytes() for j in column]


def _predict(out: np.ndarray, residual: np.ndarray, lanes: np.ndarray, weights: np.ndarray, shift: np.ndarray, lpc: np.ndarray, order: np.ndarray, alive: list[int]) -> None:
    """The recursion of quantised predictors, all their lanes side by side."""
    own = np.flatnonzero(lpc[lanes])
    at = lanes[own]
    w, s, p = weights[:, at], shift[at], order[at]
    x = out[:, at]
    for t, live in enumerate(alive):
        n = int(np.searchsorted(own, live))
        predicted = np.zeros(n, np.int64)
        for j in range(min(t, len(w))):
            predicted += w[j, :n] * x[t - 1 - j, :n]
        x[t, :n] = np.where(p[:n] <= t, (predicted >> s[:n]) + residual[t, own[:n]], x[t, :n])
    out[:, at] = x


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """text with zero bytes up to a positive multiple of unit."""
    return text + bytes(-len(text) % unit or (0 if text else unit))


def stored(docs: DataFrame, *, text_col: str = "text", media_col: str = "media", lpc: bool = True) -> DataFrame:
    """docs with n_bytes and the FLAC file of the text's bytes; lpc=False leaves the quantised linear predictor out of the choice."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(encode([payload_of(t) for t in texts], lpc=lpc), pa.binary())]

    return with_text_columns(docs, text_col, f"n_bytes bigint, `{media_col}` binary", run, _PART)


def pcm_blocks(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """media with blocks: array of (sample, pcm), the samples as unsigned bytes, decoded from the stored files."""

    def run(files: list[bytes]) -> list[pa.Array]:
        return [pa.array([[{"sample": s, "pcm": p} for s, p in own] for own in decode(files)], pa.list_(pa.struct([("sample", pa.int64()), ("pcm", pa.binary())])))]

    return with_text_columns(media, media_col, "blocks array<struct<sample:bigint,pcm:binary>>", run, 2 * _PART)


def seek_tail(blocks: list[tuple[int, bytes]], count: int) -> bytes:
    """The last count samples, from as few blocks as hold them."""
    wanted = blocks[-1][0] + len(blocks[-1][1]) - count
    return b"".join(p[max(0, wanted - s) :] for s, p in blocks if s + len(p) > wanted)


def features(pcm: bytes) -> str:
    """Number of samples, sum, energy and zero crossings of the signed samples, added up in parts."""
    total = energy = crossings = 0
    for at in range(0, len(pcm), _PART):
        begin = max(0, at - 1)  # with the sample before, for the crossing between
        x = np.frombuffer(pcm, np.uint8, min(at + _PART, len(pcm)) - begin, begin).astype(np.int64) - 128
        negative = x < 0
        crossings += int((negative[1:] != negative[:-1]).sum())
        own = x[at - begin :]
        total, energy = total + int(own.sum()), energy + int((own * own).sum())
    return f"n={len(pcm)};sum={total};energy={energy};crossings={crossings}"
