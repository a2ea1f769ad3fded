import hashlib
import struct
import zlib

import numpy as np
import pytest

from subtide.llm import media_columns as m


def by_hand(pixels, kind):
    """A PNG whose rows all take filter ``kind``, filtered sample by sample."""
    height, width = pixels.shape[:2]
    step = 1 if pixels.ndim == 2 else pixels.shape[2]
    raw = pixels.reshape(height, -1).astype(int)
    out = bytearray()
    for y in range(height):
        out.append(kind)
        for x in range(width * step):
            a = raw[y, x - step] if x >= step else 0
            b = raw[y - 1, x] if y else 0
            c = raw[y - 1, x - step] if y and x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((raw[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[step], 0, 0, 0)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return m.SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (6, 9, 3), (40, 64)])
def test_all_filters_are_undone(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    for kind in range(5):
        assert np.array_equal(m.decode_png(by_hand(pixels, kind)), pixels)
    assert np.array_equal(m.decode_png(m.encode_png(pixels)), pixels)


def test_damage_is_noticed():
    png = m.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for at in (0, 20, len(png) // 2, len(png) - 6):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(m.PngError):
            m.decode_png(bytes(bad))
    with pytest.raises(m.PngError):
        m.decode_png(png[:-3])


def test_hash_is_stable_under_small_changes():
    rng = np.random.default_rng(2)
    image = np.cumsum(np.cumsum(rng.normal(size=(96, 64)), axis=0), axis=1)
    image = ((image - image.min()) / np.ptp(image) * 255).astype(np.uint8)
    near = np.clip(image.astype(int) + rng.integers(-2, 3, image.shape), 0, 255).astype(np.uint8)
    bits = lambda h: np.unpackbits(np.frombuffer(h, np.uint8))
    assert (bits(m.cosine_hash(image)) != bits(m.cosine_hash(near))).sum() <= 6
    assert (bits(m.cosine_hash(image)) != bits(m.cosine_hash(image[::-1]))).sum() >= 12


def test_rows(spark):
    rows = [(1, "abc", 5), (1, "abc", 5), (2, None, 5), (3, "", 5), (4, "é" * 32, 5), (5, "x" * 300_000, 5), (None, "y" * 64, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media int")
    got = {(r["doc_id"], r["n_bytes"]): r for r in m.media_features(m.store_texts(df)).collect()}
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        padded = data + bytes((-len(data)) % 64 or (0 if data else 64))
        r = got[doc_id, len(data)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        png = m.text_to_png(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        assert bytes(r["phash"]).hex() == r["feature"] and len(r["feature"]) == 16
    assert m.media_features(m.store_texts(df.limit(0))).count() == 0
