"""PNG images in binary columns: chunks with checksum tests, zlib, numpy filters, and low-frequency cosine hashes."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type; palettes and bit depths other than 8 are not read.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64


class PngError(ValueError):
    """A stored image that cannot be read: no signature, a bad checksum, a missing or unsupported part."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """A (height, width) or (height, width, channels) array of 8-bit samples as PNG.

    Each row takes the filter (none, left neighbour, row above) with the least sum of absolute
    differences; the first of equals.
    """
    height, width = pixels.shape[:2]
    step = pixels.shape[2] if pixels.ndim == 3 else 1
    raw = pixels.reshape(height, width * step)
    tried = np.zeros((3, height, width * step), np.uint8)
    tried[0] = raw
    tried[1] = raw
    tried[1, :, step:] -= raw[:, :-step]
    tried[2] = raw
    tried[2, 1:] -= raw[:-1]
    sums = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = sums.argmin(axis=0)
    rows = np.empty((height, 1 + width * step), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tried[best, np.arange(height)]
    colour = {v: k for k, v in CHANNELS.items()}[step]
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of every chunk, its checksum tested."""
    if png[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise PngError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png):
            raise PngError("a chunk is cut off")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise PngError(f"bad checksum in {kind!r}")
        yield kind, data
        at += 12 + size


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters of ``rows`` (filter number, then samples).

    Runs of rows that share a filter are undone together where numpy can: left-neighbour rows by a
    running sum along the row, row-above rows by a running sum down the run. The two filters that need
    both neighbours go sample by sample.
    """
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    height, width = data.shape
    if height and kinds.max() > 4:
        raise PngError("unknown filter")
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for low, high in zip([0, *cuts], [*cuts, height]):
        if low == high:
            continue
        kind = kinds[low]
        above = data[low - 1] if low else np.zeros(width, np.uint8)
        if kind == 1:
            run = data[low:high].reshape(high - low, width // step, step)
            data[low:high] = np.cumsum(run, axis=1, dtype=np.uint8).reshape(high - low, width)
        elif kind == 2:
            data[low] += above
            data[low:high] = np.cumsum(data[low:high], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(low, high):
                up, line = (data[y - 1] if y else np.zeros(width, np.uint8)).tolist(), data[y].tolist()
                for x in range(width):
                    a, b = line[x - step] if x >= step else 0, up[x]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        c = up[x - step] if x >= step else 0
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                    line[x] = (line[x] + guess) & 255
                data[y] = line
    return data


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without palette or interlacing, as (height, width) or (height, width, channels)."""
    parts = list(chunks(png))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise PngError("no header or end")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if depth != 8 or colour not in CHANNELS or interlace:
        raise PngError("unsupported kind of image")
    step = CHANNELS[colour]
    raw = zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT"))
    if len(raw) != height * (1 + width * step):
        raise PngError("wrong amount of image data")
    out = unfilter(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * step), step)
    return out if step == 1 else out.reshape(height, width, step)


@functools.cache
def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))


def cosine_hash(gray: np.ndarray, side: int = 32, low: int = 8) -> bytes:
    """A 64-bit hash: the image averaged to ``side`` x ``side``, its ``low`` x ``low`` lowest cosine terms, each against their median.

    An axis shorter than ``side`` repeats samples; a longer one averages blocks.
    """
    small = gray
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.arange(side) * n // side
        if n < side:
            small = small.take(edges, axis=axis)
        else:
            sums = np.add.reduceat(small, edges, axis=axis, dtype=np.float64)
            shape = [1, 1]
            shape[axis] = side
            small = sums / np.diff(np.append(edges, n)).reshape(shape)
    basis = _cosines(side, low)
    terms = np.round(basis @ small.astype(np.float64) @ basis.T, 6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes()


def text_to_png(payload: bytes) -> bytes:
    return encode_png(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a 64 samples wide PNG.

    A null text counts as empty (one row of zeros). Equal texts give equal media. Only doc_id and text
    of ``docs`` are read.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes, media = [], []
            for t in batch.column(1):
                data = (t.as_py() or "").encode("utf-8")
                sizes.append(len(data))
                media.append(text_to_png(data + bytes(-len(data) % WIDTH or (WIDTH if not data else 0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id bigint, n_bytes bigint, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Reads the images of ``stored`` (doc_id, n_bytes, media) back and describes them.

    Adds payload_bytes, payload_sha256 (hex, of the samples read back), tail_crc32 (of the last 64
    samples), media_bytes, media_sha256, phash (binary) and feature (its hex). A null or unreadable
    image raises: a stored column that can't be read is an error, not a row to skip.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list] = [[] for _ in range(7)]
            for m in batch.column(2):
                png = m.as_py()
                if png is None:
                    raise PngError("no image")
                pixels = decode_png(png)
                payload = pixels.tobytes()
                phash = cosine_hash(pixels if pixels.ndim == 2 else pixels.mean(axis=2))
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), phash, phash.hex())
                for to, v in zip(out, values):
                    to.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        batches, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, phash binary, feature string"
    )
