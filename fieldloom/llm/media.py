"""Media columns: PNG files in binary columns, and low-frequency cosine-transform hashes of their pixels.

A PNG (8-bit grey or colour without palette, not interlaced) is written and read here by its zlib chunks: every chunk's CRC-32
is tested, and scan lines are unfiltered with numpy. The hash takes a 32 x 32 area mean of the grey image, the 8 x 8 lowest
cosine coefficients of it, and one bit for each that is over their median.

Defined cases: a null or empty text is 64 zero bytes; texts of any length are one image, 64 pixels wide; equal texts give equal
files and hashes; every input row gives one output row; an empty table gives none; columns other than doc_id and text are
ignored. A damaged file gives null features and its fault in ``fault`` and doesn't fail the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import base_columns, small_batches, written

WIDTH, CHUNK, LEVEL, LINES = 64, 1 << 16, 6, 1 << 14
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of the colour types without palette.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
SIDE, LOW = 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """A grey PNG of an array (height, width) of bytes; each line takes the filter (none, sub or up) of the least sum. LINES lines at a time, whatever the height."""
    deflate, data = zlib.compressobj(LEVEL), []
    above = np.zeros((1, pixels.shape[1]), np.uint8)
    for i in range(0, len(pixels), LINES):
        some = pixels[i : i + LINES]
        left, up = np.zeros_like(some), np.concatenate([above, some[:-1]])
        left[:, 1:], above = some[:, :-1], some[-1:]
        forms = np.stack([some, some - left, some - up])
        best = np.abs(forms.view(np.int8).astype(np.int16)).sum(2).argmin(0)
        data.append(deflate.compress(np.concatenate([best.astype(np.uint8)[:, None], forms[best, np.arange(len(some))]], axis=1).tobytes()))
    data = b"".join([*data, deflate.flush()])
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes (height, width * step) of filtered scan lines (height, 1 + width * step)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    n = len(out)
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    begins = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for a, b in zip(begins, [*begins[1:], n], strict=True):
        kind = kinds[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, step), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            first = max(a - 1, 0)
            out[first:b] = np.cumsum(out[first:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            wave(out, a, b, kind, step)
    return out


def wave(out: np.ndarray, a: int, b: int, kind: int, step: int) -> None:
    """Unfilters lines a to b (average or Paeth) along anti-diagonals, all lines of a diagonal at once."""
    height, width = b - a, out.shape[1] // step
    grid = np.zeros((height + 1, width + 1, step), np.int16)
    if a:
        grid[0, 1:] = out[a - 1].reshape(width, step)
    raw = out[a:b].reshape(height, width, step)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = grid[y + 1, x], grid[y, x + 1], grid[y, x]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            pl, pu, pc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((pl <= pu) & (pl <= pc), left, np.where(pu <= pc, up, corner))
        grid[y + 1, x + 1] = (raw[y, x] + guess) & 255
    out[a:b] = grid[1:, 1:].reshape(height, -1)


def decode(png: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG; ValueError if a checksum or the form is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head, ended = 8, [], None, False
    while at + 12 <= len(png) and not ended:
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(body) < n or len(png) < at + 12 + n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + n
    if head is None or not ended:
        raise ValueError("cut short")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("form not supported")
    step = CHANNELS[colour]
    lines, filled, inflate = np.empty(height * (1 + width * step), np.uint8), 0, zlib.decompressobj()
    try:
        for body in data:
            some = np.frombuffer(inflate.decompress(body), np.uint8)
            if filled + len(some) > len(lines):
                raise ValueError("wrong size")
            lines[filled : filled + len(some)] = some
            filled += len(some)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if filled != len(lines) or not inflate.eof:
        raise ValueError("wrong size")
    return unfilter(lines.reshape(height, 1 + width * step), step).reshape(height, width, step)


def means(n: int) -> np.ndarray:
    """(SIDE, n) weights of area means over n samples."""
    edges = np.arange(SIDE + 1) * n / SIDE
    cover = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.clip(cover, 0, None) * SIDE / n


COSINES = np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE) + 1) / (2 * SIDE))
ACROSS = means(WIDTH)


def grey_lines(pixels: np.ndarray, a: int, b: int) -> np.ndarray:
    """Lines a to b as one number for each pixel: whole numbers, or where there are channels their mean."""
    some = pixels[a:b]
    return some.reshape(some.shape[:2]) if some.ndim == 2 or some.shape[2] == 1 else some.mean(axis=2, dtype=np.float64)


def rows_mean(pixels: np.ndarray) -> np.ndarray:
    """(SIDE, width) area means down the image: bands of lines are summed LINES at a time, so little more than the image is in memory, however high it is."""
    n = len(pixels)
    if n <= 4 * SIDE:
        return means(n) @ grey_lines(pixels, 0, n).astype(np.float64)
    edges = np.arange(SIDE + 1) * n / SIDE
    low = np.floor(edges).astype(np.int64)
    sums = np.zeros((SIDE + 1, pixels.shape[1]))
    for k in range(SIDE):
        sums[k + 1] = sums[k] + sum(grey_lines(pixels, a, min(a + LINES, low[k + 1])).sum(0, dtype=np.float64) for a in range(low[k], low[k + 1], LINES))
    # the part of the line that an edge cuts
    cut = np.concatenate([grey_lines(pixels, a, a + 1) for a in np.minimum(low, n - 1)]).astype(np.float64)
    return np.diff(sums + (edges - low)[:, None] * cut, axis=0) * SIDE / n


def cosine_hash(pixels: np.ndarray) -> bytes:
    """LOW bytes: which of the LOW x LOW lowest cosine coefficients of the grey image are over their median."""
    small = rows_mean(pixels) @ (ACROSS if pixels.shape[1] == WIDTH else means(pixels.shape[1])).T
    low = np.round(COSINES @ small @ COSINES.T, 6)
    return np.packbits(low > np.median(low)).tobytes()


def size(text: str | None) -> int:
    """Bytes of a text."""
    return len(text or "") if (text or "").isascii() else len(text.encode("utf-8", "surrogatepass"))


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's bytes as the samples of a PNG."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, files = [], []
            for t in b.column("text").to_pylist():
                raw = payload(t)
                sizes.append(size(t))
                files.append(encode(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return base_columns(docs, "doc_id", "text").mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, hash binary, height bigint, fault string"


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes (doc_id, n_bytes, media) hold, as FEATURES: payload and file digests, and the cosine hash as a binary column."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in FEATURES.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, n, png in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                try:
                    pixels = decode(png or b"")
                    raw = memoryview(pixels.reshape(-1))
                    found = len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])
                    seen = cosine_hash(pixels), len(pixels), None
                except ValueError as e:
                    found, seen = (None, None, None), (None, None, str(e))
                out.append((doc_id, n, *found, len(png or b""), hashlib.sha256(png or b"").hexdigest(), *seen))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f.name for f in fields])

    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Write the media table to the shared folder, read it back and compute its features."""
    return features(written(media_table(docs), "media", "none"))
