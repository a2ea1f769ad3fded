"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

Works on the ``word_bpe`` kind of vocabulary (see :class:`WordBpe`): text is put in NFC, lower-cased and
cut into words; each word's bytes end in an end-of-word mark and are merged by rank.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from subtide.llm.words import Cutter, WordIds, slices

END_OF_WORD = "</w>"
_END = " "  # stands for the end-of-word mark; no byte is written as a space
#: Words whose ids are kept, in each of two generations, and pairs of tokens whose compatibility is.
KEPT_WORDS = 1 << 15
KEPT_SEAMS = 1 << 16
#: Bytes of text encoded, and sent on, at a time.
SLICE_BYTES = 2 << 20
LITTLE = sys.byteorder == "little"
#: The same of a query that does nothing else and has the memory.
WIDE_SLICE_BYTES = 8 << 20
_BLOCK = 4096  # positions whose matches are looked up at a time


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordBpe:
    """An encoder and decoder for a tokenizer file whose token ids rise with merge rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cutter = Cutter(path)
        self.special = self.cutter.special
        self.letters = byte_letters()
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *self.special.values()])
        strings = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token
        # A token's halves in the merge that makes it; a token that no merge makes is its own halves.
        self.left, self.right = list(range(size)), list(range(size))
        self.size = size
        self.merged: dict[int, int] = {}  # by seam
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            self.left[made], self.right[made] = vocab[a], vocab[b]
            self.merged[vocab[a] * size + vocab[b]] = made
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            symbols = token.removesuffix(END_OF_WORD) + _END if token.endswith(END_OF_WORD) and token != END_OF_WORD else token
            self.length[i] = len(symbols)
            self.automaton.add_word(symbols, i)
        self.automaton.make_automaton()
        self.longest = max(self.length)
        self.compatible: dict[int, bool] = {}
        # Decoding: all token strings in one buffer, cut at offsets; tokens are joined by one space.
        parts = [s.encode("utf-8") + b" " for s in strings]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))

    # -- encoding ---------------------------------------------------------------------------------

    def _fits(self, first: int, second: int) -> bool:
        """True if merging by rank can leave ``first`` and ``second`` side by side.

        Walks the merges that made both tokens from the last to the first: at each step the halves
        that touch at the seam must not form a pair that would have been merged earlier.
        """
        seam = first * self.size + second
        known = self.compatible.get(seam)
        if known is not None:
            return known
        a, b, before = first, second, 1 << 62
        while True:
            made = self.merged.get(a * self.size + b)
            if made is not None and made < before:
                good = False
                break
            if a > b:  # the left token was made later: undo its last merge
                before, half = a, self.right[a]
                if half != a:
                    a = half
                    continue
                before, half = b + 1, self.left[b]
                if half == b:
                    good = True
                    break
                b = half
            else:
                before, half = b + 1, self.left[b]
                if half != b:
                    b = half
                    continue
                before, half = a, self.right[a]
                if half == a:
                    good = True
                    break
                a = half
        if len(self.compatible) >= KEPT_SEAMS:
            self.compatible.clear()
        self.compatible[seam] = good
        return good

    def _matches(self, symbols: str, low: int, high: int) -> list[list[int]]:
        """The tokens that begin at each position from ``low`` to before ``high``, the shortest first."""
        found: list[list[int]] = [[] for _ in range(high - low)]
        length = self.length
        for end, token in self.automaton.iter(symbols, low, min(len(symbols), high + self.longest)):
            start = end - length[token] + 1
            if start < high:
                found[start - low].append(token)  # ends ascend, so lengths do
        return found

    def _greedy(self, symbols: str) -> tuple[array, int]:
        """The longest tokens from left to right while neighbours fit, and how many symbols they cover: what :meth:`encode_symbols` takes before it first has to try a shorter one."""
        known, size, fits, length = self.compatible.get, self.size, self._fits, self.length
        out, covered, before = array("I"), 0, -1
        for end, token in self.automaton.iter_long(symbols):
            if end + 1 != covered + length[token]:
                break
            if before >= 0:
                good = known(before * size + token)
                if not (fits(before, token) if good is None else good):
                    break
            covered = end + 1
            out.append(token)
            before = token
        return out, covered

    def encode_symbols(self, symbols: str) -> array:
        """Token ids of one word, given as byte letters and an end mark: longest match first, shorter ones on backtracking.

        The encoding of every prefix is unique, so a position from which no token leads on is marked
        dead and never entered again: each position is left at most once for each token there.
        """
        n = len(symbols)
        out, pos = self._greedy(symbols)
        if pos == n:
            return out
        length, fits = self.length, self._fits
        dead, below = bytearray(n + 1), 1 << 30
        first = pos - length[out[-1]] if out else 0  # most often the token before is the one to change
        begins = self._matches(symbols, first, min(n, first + _BLOCK))
        while pos < n:
            if not first <= pos < first + len(begins):
                first = pos - pos % _BLOCK
                begins = self._matches(symbols, first, min(n, first + _BLOCK))
            for token in reversed(begins[pos - first]):
                size = length[token]
                if size < below and not dead[pos + size] and (not out or fits(out[-1], token)):
                    out.append(token)
                    pos, below = pos + size, 1 << 30
                    break
            else:
                dead[pos] = 1
                below = length[out.pop()]
                pos -= below
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        letters, special = self.letters, self.special
        out = []
        for word in words:
            i = special.get(word)
            if i is not None:
                out.append(pack("<I", i))
                continue
            # Printable letters of ASCII stand for themselves; a space among them would be an end mark.
            plain = word.isascii() and word.isprintable() and " " not in word
            symbols = (word if plain else "".join([letters[b] for b in word.encode("utf-8")])) + _END
            found = self.encode_symbols(symbols)
            out.append(found.tobytes() if LITTLE else pack(f"<{len(found)}I", *found))
        return out

    def word_ids(self, slice_bytes: int = SLICE_BYTES) -> WordIds:
        """Encodes batches; what it keeps of words goes with it."""
        return WordIds(self.cutter, self.encode_words, KEPT_WORDS, slice_bytes)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null."""
        return next(self.word_ids().of_texts(pa.array([text], pa.string()))).tobytes()

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The decoded text in UTF-8: token strings joined by a space, special ones too, gathered by offset."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, (bytes, bytearray)) else np.asarray(ids)
        if not len(ids):
            return b""
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[where].tobytes()[:-1]


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The encoder of a tokenizer file, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


#: Ids gathered at a time when decoding, so that a very long text needs little memory beyond itself.
DECODE_IDS = 1 << 18


def decoded_parts(bpe: WordBpe, ids: bytes) -> Iterator[bytes]:
    """``bpe.decode(ids)`` in parts."""
    step = 4 * DECODE_IDS
    for at in range(0, len(ids), step):
        yield (b" " if at else b"") + bpe.decode(ids[at : at + step])


def encode_column(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with column ``to``: the ids of ``text`` as little-endian unsigned 32-bit integers in a binary column.

    Null and empty texts have no ids (an empty binary). Row by row, so ties, repeated rows and empty
    tables need nothing special. A column already named ``to`` is replaced.
    """
    names = [c for c in docs.columns if c != to]
    held = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + f", `{to}` binary"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).word_ids().of_texts
        for batch in rows:
            ids = pa.array([x.tobytes() for x in encode(batch.column(names.index(text)))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, to])

    return held.mapInArrow(batches, schema)


def round_trip(docs: DataFrame, path: str, keep: list[str] | None = None, with_ids: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, the ``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text; with ``ids`` (binary) if asked for.

    Encodes the text, hashes the ids, decodes the ids and hashes the decoded UTF-8. Null and empty
    texts give 0 tokens and the hash of nothing twice. One row per row, in no order; other columns
    of ``docs`` are not read. Texts are taken ``slice_bytes`` at a time: more of them share words, and take memory.
    """
    held = docs.select("doc_id", *(keep or []), F.col("text").alias("_text"))
    names = held.columns[:-1]
    made = {"n_tokens": pa.int64(), **({"ids": pa.binary()} if with_ids else {}), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        encode = bpe.word_ids(slice_bytes).of_texts
        for batch in rows:
            at = 0
            for texts in slices(batch.column(len(names)), slice_bytes):
                out: dict[str, list] = {name: [] for name in made}
                for found in encode(texts):
                    ids = found.tobytes()
                    text = hashlib.sha256()
                    for part in decoded_parts(bpe, ids):
                        text.update(part)
                    out["n_tokens"].append(len(found))
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(text.hexdigest())
                    if with_ids:
                        out["ids"].append(ids)
                kept = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(out[n], kind) for n, kind in made.items()]], names=[*names, *made])
                at += len(texts)
        pa.default_memory_pool().release_unused()  # the worker lives on, and other operators follow

    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = ", ".join([*[f"`{n}` {types[n]}" for n in names], "n_tokens bigint", *(["ids binary"] if with_ids else []), "ids_sha256 string", "decoded_sha256 string"])
    return held.mapInArrow(batches, schema)
