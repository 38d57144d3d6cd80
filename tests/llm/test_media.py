import hashlib
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from fieldloom.llm import media

from .conftest import ROWS


def filtered(pixels, step, kinds):
    """Scan lines by the format's text, byte by byte."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(pixels.shape[1]):
            left = int(pixels[y, x - step]) if x >= step else 0
            up = int(pixels[y - 1, x]) if y else 0
            corner = int(pixels[y - 1, x - step]) if y and x >= step else 0
            p = left + up - corner
            paeth = min((abs(p - v), k, v) for k, v in enumerate((left, up, corner)))[2]
            line.append((int(pixels[y, x]) - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_all_filters(step):
    rng = np.random.default_rng(step)
    pixels = rng.integers(0, 256, (40, 17 * step), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40)
    assert (media.unfilter(filtered(pixels, step, kinds), step) == pixels).all()


def test_round_trip_and_damage():
    pixels = np.random.default_rng(1).integers(0, 256, (3000, 64), dtype=np.uint8)
    png = media.encode(pixels)
    assert (media.decode(png)[:, :, 0] == pixels).all()
    assert png.count(b"IDAT") > 1
    for at in (20, 60, len(png) - 8, len(png) // 2):
        with pytest.raises(ValueError):
            media.decode(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    for cut in (0, 8, 40, len(png) - 12):
        with pytest.raises(ValueError):
            media.decode(png[:cut])


def test_colour():
    pixels = np.random.default_rng(2).integers(0, 256, (9, 5 * 3), dtype=np.uint8)
    lines = np.concatenate([np.zeros((9, 1), np.uint8), pixels], axis=1)
    head = media.chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 9, 8, 2, 0, 0, 0))
    png = media.SIGNATURE + head + media.chunk(b"tEXt", b"a\0b") + media.chunk(b"IDAT", zlib.compress(lines.tobytes())) + media.chunk(b"IEND", b"")
    assert (media.decode(png).reshape(9, 15) == pixels).all()


def test_hash_is_the_cosine_transform():
    pixels = np.random.default_rng(3).integers(0, 256, (96, 64), dtype=np.uint8)
    small = pixels.astype(float).reshape(32, 3, 32, 2).mean((1, 3))
    low = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    assert media.cosine_hash(pixels) == np.packbits(low > np.median(low)).tobytes()


def test_near_images_have_near_hashes():
    c = np.random.default_rng(2).normal(size=(8, 8))  # an image of which every low coefficient matters
    waves = lambda n: np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(n) + 1) / (2 * n))
    smooth = np.clip(127 + 12 * waves(640).T @ c @ waves(64), 0, 255).astype(np.uint8)
    noisy = np.clip(smooth + np.random.default_rng(1).integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    a, b = (int.from_bytes(media.cosine_hash(p)) for p in (smooth, noisy))
    assert (a ^ b).bit_count() <= 8


def test_documents(odd):
    rows = media.media_features(odd).collect()
    assert len(rows) == len(ROWS)
    by_text = {}
    for i, t in ROWS:
        raw = (t or "").encode()
        pay = raw + bytes(-len(raw) % 64 if raw else 64)
        by_text.setdefault(i, []).append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in by_text[r.doc_id] and r.fault is None
    sixes = [(r.media_sha256, bytes(r.hash), r.media_bytes) for r in rows if r.doc_id in (6, 7)]
    assert len(set(sixes)) == 1


def test_no_documents_and_bad_files(spark, no_rows):
    assert media.media_features(no_rows).collect() == []
    bad = spark.createDataFrame([(1, 3, bytearray(b"abc")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.hash, r.fault) for r in media.features(bad).orderBy("doc_id").collect()] == [(None, "not a PNG")] * 2


def test_blocks_of_lines_give_the_same_file(monkeypatch):
    pixels = np.random.default_rng(7).integers(0, 40, (1000, 64), dtype=np.uint8)
    whole = media.encode(pixels)
    monkeypatch.setattr(media, "LINES", 37)
    assert media.encode(pixels) == whole and (media.decode(whole)[:, :, 0] == pixels).all()


def test_means_of_high_images():
    """Band sums against the full matrix of weights, also where edges cut lines and with channels."""
    rng = np.random.default_rng(7)
    for n in (1, 31, 129, 1000, 40_000):
        pixels = rng.integers(0, 256, (n, 64, 1), dtype=np.uint8)
        assert np.allclose(media.rows_mean(pixels), media.means(n) @ pixels[:, :, 0])
    colour = rng.integers(0, 256, (500, 20, 3), dtype=np.uint8)
    assert np.allclose(media.rows_mean(colour), media.means(500) @ colour.mean(2))


def test_a_text_of_100_mb_fits_a_worker():
    code = (
        "import resource, numpy as np; from fieldloom.llm import media;"
        "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
        "text = (np.random.default_rng(1).integers(97, 123, 1_000_000, dtype=np.uint8).tobytes().decode()) * 100;"
        "raw = media.payload(text); png = media.encode(np.frombuffer(raw, np.uint8).reshape(-1, media.WIDTH)); n = len(raw); del raw;"
        "pixels = media.decode(png); assert pixels.size == n and len(media.cosine_hash(pixels)) == 8;"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)"
    )
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(media.__file__).parents[2]).stdout
    assert int(used) < 700  # MB
