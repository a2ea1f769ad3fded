"""Token ids of whole batches of texts under a ``word_bpe`` vocabulary: each distinct word of a slice is encoded once.

Text under such a vocabulary is put in NFC, lower-cased and cut into words, and no word reaches over white
space. So a slice's distinct chunks between white space are found first, then the distinct words in
them; only words are encoded, and the ids of chunks and texts are gathered from theirs.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# Fixed value: the word pattern of this kind of vocabulary, as its tokenizer file has it.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_WORDS_AND_BLANKS = regex.compile(" |" + WORD)

#: Chunks cut into words at a time.
BLOCK_CHUNKS = 1 << 13


def _newer(text: str) -> bool:
    """Has characters that Python's Unicode tables don't know."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


class Cutter:
    """Cuts chunks into words as a tokenizer file says; its special tokens are words of their own."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> list[str]:
        """The words of a text without special tokens, and the blanks in it."""
        if text.isascii():
            return _WORDS_AND_BLANKS.findall(text.lower())
        # Letter by letter, a capital sigma is lower-cased without a look at its neighbours.
        return _WORDS_AND_BLANKS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        """The same of a chunk with characters newer than Python's Unicode tables, whose class is the library's to say."""
        out = []
        for part in self.pattern.split(text):
            if part in self.special:
                out.append(part)
                continue
            normal = self.library.normalizer.normalize_str(part)
            out += [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def cut(self, chunks: list[str]) -> list[str]:
        """The words of the chunks in order, with a blank after each chunk."""
        joined = " ".join(chunks) + " "
        if not joined.isascii() and _newer(joined):
            out = []
            for chunk in chunks:
                out += [*(self._by_library(chunk) if _newer(chunk) else self.cut([chunk])[:-1]), " "]
            return out
        if self.special and "<" in joined:
            return [w for part in self.pattern.split(joined) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(joined)


class WordIds:
    """Ids of texts whose words are encoded by ``encode`` (words to little-endian unsigned 32-bit ids, one bytes object each).

    Up to ``kept`` recently used words, in each of two generations, are kept from slice to slice of
    ``slice_bytes`` of text (one longer text is a slice of its own).
    """

    def __init__(self, cutter: Cutter, encode: Callable[[list[str]], list[bytes]], kept: int, slice_bytes: int):
        self.cutter, self.encode, self.kept, self.slice_bytes = cutter, encode, kept, slice_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self.young) >= self.kept:
            self.old, self.young = self.young, {}
        young = self.young
        missing = set(words).difference(young)
        young |= {w: self.old[w] for w in missing if w in self.old}
        unknown = [w for w in missing if w not in self.old and w != " "]
        young |= zip(unknown, self.encode(unknown))
        young[" "] = b""
        return list(map(young.__getitem__, words))

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has."""
        ids, sizes = [], []
        for at in range(0, len(chunks), BLOCK_CHUNKS):
            words = self.cutter.cut(chunks[at : at + BLOCK_CHUNKS])
            found = self._look_up(words)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
            blanks = np.fromiter(map(" ".__eq__, words), bool, len(words))
            ids.append(np.frombuffer(b"".join(found), "<u4"))
            sizes.append(np.diff(ends[blanks], prepend=0))
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def of_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order, as an array of unsigned 32-bit integers; none for null and empty texts."""
        for part in slices(texts, self.slice_bytes):
            chunks = pc.ascii_split_whitespace(pc.fill_null(part, ""))
            coded = chunks.values.dictionary_encode()
            ids, sizes = self.of_chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            by_chunk = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids))
            taken = by_chunk.take(coded.indices)
            values, ends = np.asarray(taken.values), np.asarray(taken.offsets)[np.asarray(chunks.offsets)]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield values[a:b]


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """``texts`` in slices of at most ``limit`` bytes of text, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(at, end - at)
        at = end
