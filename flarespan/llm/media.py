"""Media columns: lossless 8-bit greyscale PNG in binary columns, checked reading, cosine-transform hashes.

``store`` turns a binary payload into a PNG file 64 samples wide, ``load`` reads it back (chunk
checksums, zlib stream, numpy unfiltering of all five filter types), ``dct_hash`` hashes its low
frequencies.  A null or empty text is one row of zero samples.  Long texts are stored whole.  Equal
texts have equal media; repeated rows are each stored.  Damaged media raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

WIDTH = 64
#: Rows that are filtered at a time.
ROWS = 1 << 14
#: Bytes of compressed data in one IDAT chunk.
IDAT_BYTES = 1 << 16
#: Side of the averaged picture and of the block of low frequencies that is hashed.
SIDE, LOW = 32, 8

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def padded(data: bytes) -> bytes:
    """The payload: zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Filter kinds and samples of some rows, with the row above them; each row takes the filter (none, sub, up) with the least sum of magnitudes."""
    tries = np.empty((3, *rows.shape), np.uint8)
    tries[0] = rows
    tries[1, :, 0] = rows[:, 0]
    np.subtract(rows[:, 1:], rows[:, :-1], out=tries[1, :, 1:])
    np.subtract(rows[0], above, out=tries[2, 0])
    np.subtract(rows[1:], rows[:-1], out=tries[2, 1:])
    best = np.abs(tries.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64).argmin(0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tries[best, np.arange(len(rows))]
    return lines


def store(payload: bytes, level: int = 4) -> bytes:
    """PNG of a payload, made some rows at a time."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed, above, body = zlib.compressobj(level), np.zeros(WIDTH, np.uint8), []
    for lo in range(0, len(rows), ROWS):
        part = rows[lo : lo + ROWS]
        body.append(packed.compress(filtered(part, above).tobytes()))
        above = part[-1]
    body = b"".join([*body, packed.flush()])
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    parts = [chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([SIGNATURE, head, *parts, chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows of samples from filtered rows.  Whole runs of none, sub and up rows go at once; the others diagonal by diagonal."""
    out = lines.copy()
    if (kinds > PAETH).any():
        raise ValueError("unknown row filter")
    sub = kinds == SUB
    out[sub] = np.cumsum(lines[sub], axis=1, dtype=np.uint8)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(kinds)], strict=True):
        kind = kinds[lo]
        if kind < UP:
            continue
        above = out[lo - 1] if lo else np.zeros(lines.shape[1], np.uint8)
        if kind == UP:
            out[lo:hi] = np.cumsum(np.vstack([above[None], lines[lo:hi]]), axis=0, dtype=np.uint8)[1:]
            continue
        out[lo:hi] = diagonals(kind, lines[lo:hi], above)
    return out


def diagonals(kind: int, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo average or Paeth on rows of one kind: a sample needs those to its left and above, so all samples of a diagonal go at once."""
    n, width = lines.shape
    got = np.zeros((n + 1, width + 1), np.int32)
    got[0, 1:] = above
    for d in range(n + width - 1):
        r = np.arange(max(0, d - width + 1), min(n, d + 1))
        c = d - r
        left, up, corner = got[r + 1, c], got[r, c + 1], got[r, c]
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            a, b, e = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))
        got[r + 1, c + 1] = (lines[r, c] + guess) & 255
    return got[1:, 1:].astype(np.uint8)


def load(media: bytes) -> np.ndarray:
    """The samples, one row for each picture row; every checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, data, end = media[at + 4 : at + 8], media[at + 8 : at + 8 + n], at + 12 + n
        if end > len(media) or zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended, at = kind == b"IEND", end
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"zlib stream: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def cosines() -> np.ndarray:
    """The first LOW rows of the orthonormal cosine transform of SIDE points."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE)) * np.where(k == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def shrink(rows: np.ndarray) -> np.ndarray:
    """SIDE x SIDE means; rows or columns are repeated where there are fewer."""
    out = rows.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        if n < SIDE:
            out = np.take(out, edges, axis)
        else:
            shape = [1, 1]
            shape[axis] = SIDE
            out = np.add.reduceat(out, edges, axis) / np.diff(np.r_[edges, n]).reshape(shape)
    return out


def dct_hash(rows: np.ndarray, c: np.ndarray) -> str:
    """64 bits as hex: which of the low frequencies exceed their median (the mean level left out of it)."""
    low = np.round(c @ shrink(rows) @ c.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and ``media``: each whole text as PNG in a binary column."""

    def run(raw):
        return {"n_bytes": [len(x) for x in raw], "media": [store(padded(x)) for x in raw]}

    return map_texts(docs, run, {"n_bytes": "long", "media": "binary"})


def media_features(media: DataFrame) -> DataFrame:
    """Read the ``media`` column back: payload, sizes, digests and ``feature``, the cosine-transform hash."""

    def run(raw):
        c, out = cosines(), {k: [] for k in kinds}
        for x in raw:
            rows = load(x)
            payload = rows.tobytes()
            got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(x), hashlib.sha256(x).hexdigest(), dct_hash(rows, c))
            for k, v in zip(kinds, got, strict=True):
                out[k].append(v)
        return out

    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return map_texts(media, run, kinds, ("doc_id", "n_bytes"), text="media")
