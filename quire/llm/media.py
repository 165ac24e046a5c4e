"""Media columns: texts as PNG images, checked, unfiltered and hashed.

The payload (UTF-8 bytes of the text, zero-padded to a positive multiple of 64)
becomes an 8-bit greyscale PNG, 64 samples wide, held in a binary column. The
reader walks the chunks, tests every CRC, inflates the IDAT stream, undoes the
row filters with numpy and computes a low-frequency cosine-transform hash.
One row in, one row out: no shuffle, and memory is that of one document.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Rows that share one choice of row filter.
STRIP = 64
IDAT_BYTES = 1 << 20
GRID, LOW = 32, 8


def payload_of(text: bytes) -> bytes:
    pad = -len(text) % WIDTH if text else WIDTH
    return text + bytes(pad)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """Greyscale PNG of a payload whose length is a positive multiple of 64."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = len(image)
    filtered = np.empty((rows, WIDTH + 1), np.uint8)
    for top in range(0, rows, STRIP):
        part = image[top : top + STRIP]
        left = part.copy()
        left[:, 1:] -= part[:, :-1]
        up = part.copy()
        up[1:] -= part[:-1]
        if top:
            up[0] -= image[top - 1]
        tried = (part, left, up)
        cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in tried]
        best = cost.index(min(cost))
        filtered[top : top + STRIP, 0] = best
        filtered[top : top + STRIP, 1:] = tried[best]
    packed = zlib.compress(filtered.tobytes(), level)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", header) + data + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def _unfilter(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Undo the five PNG row filters for one-byte pixels; runs of equal filters at once."""
    out = data.copy()
    rows, width = data.shape
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, rows], strict=True):
        kind = int(kinds[lo])
        if kind > 4:
            raise ValueError(f"unknown row filter {kind}")
        above = out[lo - 1] if lo else np.zeros(width, np.uint8)
        if kind == 1:
            np.add.accumulate(data[lo:hi], axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == 2:
            out[lo] = data[lo] + above
            np.add.accumulate(out[lo:hi], axis=0, dtype=np.uint8, out=out[lo:hi])
        elif kind > 2:
            for r in range(lo, hi):
                line, up, left, corner = data[r].tolist(), (out[r - 1] if r else np.zeros(width, np.uint8)).tolist(), 0, 0
                for x in range(width):
                    guess = (left + up[x]) // 2 if kind == 3 else _paeth(left, up[x], corner)
                    left, corner = (line[x] + guess) & 255, up[x]
                    line[x] = left
                out[r] = line
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale, non-interlaced PNG; ValueError where it is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, header, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        stored = media[at + 8 + size : at + 12 + size]
        if len(body) != size or len(stored) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", stored)[0]:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, rows, depth, colour, _, _, interlace = header
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only 8-bit greyscale without interlace is read")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != rows * (width + 1):
        raise ValueError("the image data has another size than its header says")
    raw = raw.reshape(rows, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:])


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


def _resize(a: np.ndarray) -> np.ndarray:
    """Mean of 32 bands along axis 0 (nearest row where there are fewer than 32)."""
    n = len(a)
    if n < GRID:
        return a[np.arange(GRID) * n // GRID].astype(np.float64)
    edges = np.arange(GRID + 1) * n // GRID
    sums = np.add.reduceat(a, edges[:-1], axis=0, dtype=np.int64)
    return sums / np.diff(edges)[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: the 8 x 8 lowest DCT coefficients of a 32 x 32 version against their median."""
    small = _resize(image).reshape(GRID, GRID, -1).mean(axis=2) if image.shape[1] == 2 * GRID else _resize(_resize(image).T).T
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


STORED = "doc_id long, n_bytes long, media binary"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([encode_png(payload_of(t)) for t in texts], pa.binary())})


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            media = media.as_py()
            image = decode_png(media)
            back = image.tobytes()
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and ``media``, a binary column with the PNG of the text, of every
    row of docs (doc_id, text), as a written table.

    Null text: as the empty text, whose payload is 64 zero bytes. Null doc_id: kept. Equal
    texts give equal values; repeated rows give repeated rows; an empty table gives an empty
    one; other columns are not carried.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(_stored_rows, STORED), "media")


def features(media: DataFrame) -> DataFrame:
    """Sizes, digests and hash of each image of stored(), from the bytes that are read back. A damaged
    image ends the job with a ValueError; stored() makes none of a null text (it is an empty one), so
    each row has an image. A null doc_id comes back null, repeated rows give repeated rows, an empty
    table gives an empty one; other columns are not carried."""
    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(_read_rows, OUT), "features")


def media_columns(docs: DataFrame) -> DataFrame:
    """features() of the table that stored() makes of docs: one row per input row."""
    return features(stored(docs))
