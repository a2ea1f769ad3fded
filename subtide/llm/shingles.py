"""Sets of word shingles as sorted 64-bit hashes, whole batches of texts at a time in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are runs of other bytes than these; none of them occurs inside a UTF-8 sequence.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text hashed at a time.
PIECE = 1 << 17

#: Longer words are hashed one by one.
LONG_WORD = 4096

_rng = np.random.default_rng(20240229)
_START, _STEP = (np.uint64(int(x) * 2 + 1) for x in _rng.integers(0, 2**63, 2))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word in ``data``; a word also ends where a text begins (``breaks``)."""
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[breaks[breaks < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return _hashes(data, starts, ends - starts), starts


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in lower case (A-Z alone): its size, then eight bytes after eight go through ``mix``.

    Mixing is one-to-one, so words of one size up to eight bytes never fall together; longer ones do
    only by chance, whatever their pattern.
    """
    low = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    out = mix(sizes.astype(np.uint64) * _STEP + _START)
    short = sizes <= LONG_WORD
    todo = slice(None) if short.all() else np.flatnonzero(short)
    at = starts[todo]
    left = sizes[todo]
    while len(at):
        out[todo] = mix(out[todo] ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        todo = more if isinstance(todo, slice) else todo[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(~short).tolist():
        own = low[starts[i] : starts[i] + sizes[i]]
        out[i] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little")
    return out


def _long_word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, a piece of whole words at a time."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and _IS_WORD[data[end]] and _IS_WORD[data[end - 1]]:
            step = np.flatnonzero(~_IS_WORD[data[end : end + PIECE]])
            end = end + int(step[0]) if len(step) else min(len(data), end + PIECE)
        out.append(word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingle set of each text, whose words' hashes follow one another in ``hashes``."""
    ends = np.cumsum(counts)
    if len(hashes) >= k:
        rolled = hashes[: len(hashes) - k + 1]
        for i in range(1, k):
            rolled = rolled * _STEP + hashes[i : len(hashes) - k + 1 + i]
        rolled = mix(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= k:
            own = np.sort(rolled[end - n : end - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            whole = np.array([n], np.uint64)
            for h in hashes[end - n : end]:
                whole = whole * _STEP + h
            out.append(mix(mix(whole)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The set of each text: its distinct ``k``-word shingles; with fewer words the whole sequence as one; empty for null or no words."""
    n = len(texts)
    if not n:
        return
    binary = texts.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + n + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    valid = np.ones(n, bool) if not texts.null_count else np.asarray(texts.is_valid().to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        end = at + 1
        while end < n and offsets[end + 1] - offsets[at] <= PIECE:
            end += 1
        part = data[offsets[at] : offsets[end]]
        if end == at + 1 and len(part) > PIECE:
            hashes = _long_word_hashes(part)
            counts = np.array([len(hashes)])
        elif len(part):
            local = offsets[at : end + 1] - offsets[at]
            hashes, starts = word_hashes(part, local[:-1])
            counts = np.diff(np.searchsorted(starts, local))
        else:
            hashes, counts = np.empty(0, np.uint64), np.zeros(end - at, np.int64)
        for i, own in enumerate(_sets(hashes, counts, k), at):
            yield own if valid[i] else np.empty(0, np.uint64)
        at = end
