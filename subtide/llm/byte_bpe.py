"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 state machine.

A sequence of tokens is the encoding of a word exactly if any two neighbours can stand side by side (see
``Ranks.fits``), so the merges compile into a transducer whose configurations are the last whole token and
a place in the trie of the next. Determinised, a state is a set of such configurations, each with the tokens it
has beyond what all agree on; a token goes out as soon as all agree on it, which is at most one longest token
after its last byte. States and transitions are made when a text first needs them and thrown away when there are too many.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from subtide.llm.words import slices

# Fixed value: the pattern whose matches are encoded one by one. White space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
#: The same for ASCII, where the standard library's matcher does.
_ASCII_WORDS = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)

#: Bounds of what a worker keeps: states, seams, bytes of words in each of two generations, steps of the decoder.
KEPT_STATES = 1 << 18
KEPT_SEAMS = 1 << 18
KEPT_WORD_BYTES = 48 << 20
KEPT_DECODER_STEPS = 1 << 17
#: A word in memory costs about so much beside its letters. Longer words aren't kept.
WORD_COST = 270
LONGEST_KEPT = 128
#: Letters cut into words at a time, and bytes of text taken from Arrow at a time.
PIECE = 1 << 17
SLICE_BYTES = 4 << 20


def _cut(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORDS.findall(text)
    # Letters newer than the library's Unicode tables are signs there: neither letter, number nor blank.
    newer = {ord(c): "!" for c in set(text) if c > "\x7f" and unicodedata.category(c) == "Cn"}
    if newer:
        return [text[m.start() : m.end()] for m in _WORDS.finditer(text.translate(newer))]
    return _WORDS.findall(text)


def words(text: str) -> Iterator[list[str]]:
    """The words of ``text``, a piece of it at a time.

    Which match it is depends on two letters after its end at most, so those that end well inside a piece are
    right; the next piece begins after them, and is longer if there are none.
    """
    at, size = 0, PIECE
    while len(text) - at > size:
        found = _cut(text[at : at + size])
        beyond = 0
        while found and beyond < 3:
            beyond += len(found.pop())
        if found:
            at += size - beyond
            size = PIECE
            yield found
        else:
            size *= 2
    if at < len(text):
        yield _cut(text[at:])


class Ranks:
    """The tokens of a rank file. Every token of several bytes must come of two tokens of lower rank, as in files of trained merges."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = [b""] * (1 + max(self.rank.values()))
        for token, rank in self.rank.items():
            self.token[rank] = token
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}

    def halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a byte's are itself."""
        known = self._halves.get(rank)
        if known is None:
            token = self.token[rank]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                made, at = min((self.rank.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if made >= rank:
                    raise ValueError(f"no merge makes token {rank}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self._halves[rank] = (self.rank[parts[0]], self.rank[parts[-1]])
        return known

    def fits(self, first: int, second: int) -> bool:
        """True if merging by rank leaves ``first`` and ``second`` side by side.

        Their merges are undone from the last on; a pair that touches at the seam must at no time have been
        one to merge before the merge undone last.
        """
        seam = first << 32 | second
        known = self._fits.get(seam)
        if known is None:
            a, b, before, good = first, second, len(self.token), True
            while True:
                if self.rank.get(self.token[a] + self.token[b], before) < before:
                    good = False
                    break
                left, right = self.halves(a)[1], self.halves(b)[0]
                if left == a and right == b:
                    break
                if right == b or (left != a and a > b):
                    a, before = left, a
                else:
                    # of equal merges the left one comes first, so one at the seam would have come before this
                    b, before = right, b + 1
            if len(self._fits) >= KEPT_SEAMS:
                self._fits.clear()
            known = self._fits[seam] = good
        return known


class Transducer:
    """Bytes in, token ids out: states and steps are made as they are needed.

    A state is the dictionary of the steps known from it, by byte: (next state, tokens that go out). Under -1 it
    has its configurations (node, last whole token, tokens held back), and under -2 what is left to say if the word ends.
    """

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        # The trie: the steps from a node by a byte, and the token that ends at a node.
        leaf: dict[int, int] = {}
        self.down: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.rank.items():
            node = 0
            for byte in token:
                after = self.down[node].get(byte)
                if after is None:
                    if self.down[node] is leaf:
                        self.down[node] = {}
                    after = self.down[node][byte] = len(self.ends)
                    self.ends.append(-1)
                    self.down.append(leaf)
                node = after
            self.ends[node] = rank
        self.states: dict[tuple, dict] = {}
        self._forget()

    def _forget(self) -> None:
        for state in self.states.values():  # states lead to one another in circles
            state.clear()
        self.states.clear()
        self.start = self._state(((0, -1, ()),))

    def _state(self, inside: tuple) -> dict:
        state = self.states.get(inside)
        if state is None:
            node, _, held = inside[-1]
            state = self.states[inside] = {-1: inside, -2: held if node == 0 else ()}
        return state

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The state after ``byte`` and the tokens that go out on it."""
        down, ends, fits = self.down, self.ends, self.ranks.fits
        after, whole, agree = [], None, True
        for node, last, held in state[-1]:  # the deepest node first, each of another depth
            child = down[node].get(byte)
            if child is None:
                continue
            if down[child]:
                after.append((child, last, held))
                agree = agree and held != ()
            token = ends[child]
            if token >= 0 and (last < 0 or fits(last, token)):
                whole = (0, token, (*held, token))  # the encoding so far; there is one
        if whole:
            after.append(whole)
        agreed = ()
        if agree:
            agreed = functools.reduce(_shared, [held for *_, held in after])
            if agreed:
                after = [(node, last, held[len(agreed) :]) for node, last, held in after]
        if len(self.states) >= KEPT_STATES:
            self._forget()
            return self._state(tuple(after)), agreed
        step = state[byte] = (self._state(tuple(after)), agreed)
        return step

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word."""
        out: list[int] = []
        state = self.start
        for byte in word:
            step = state.get(byte)
            state, tokens = step if step is not None else self._step(state, byte)
            if tokens:
                out += tokens
        out += state[-2]
        return out


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """What both begin with."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return a[:n]


def _utf8_steps() -> dict[tuple[str, int], str]:
    """The well-formed sequences as a machine: what may follow, by (what is expected, byte). "" expects a character."""
    kinds = {"tail": (0x80, 0xBF), "E0": (0xA0, 0xBF), "ED": (0x80, 0x9F), "F0": (0x90, 0xBF), "F4": (0x80, 0x8F)}
    steps = {("", b): "" for b in range(0x80)}
    steps |= {("", b): "tail" for b in range(0xC2, 0xE0)}
    steps |= {("", b): {0xE0: "E0 tail", 0xED: "ED tail"}.get(b, "tail tail") for b in range(0xE0, 0xF0)}
    steps |= {("", b): {0xF0: "F0 tail tail", 0xF4: "F4 tail tail"}.get(b, "tail tail tail") for b in range(0xF0, 0xF5)}
    for expected in {e for e in steps.values() if e} | {"tail tail", "tail"}:
        kind, _, more = expected.partition(" ")
        steps |= {(expected, b): more for b in range(kinds[kind][0], kinds[kind][1] + 1)}
    return steps


class StreamDecoder:
    """Token ids in, whole characters out: bytes of a character that isn't complete wait for the next token.

    Bytes that are no UTF-8 go out by themselves as soon as that is known; as text they are U+FFFD.
    """

    UTF8 = _utf8_steps()

    def __init__(self, token: list[bytes]):
        self.token = token
        self.rows: dict[bytes, dict] = {}
        self.kept = 0
        self.waiting = b""

    def _row(self, waiting: bytes) -> dict:
        """The steps known from the state in which ``waiting`` has been read."""
        return self.rows.setdefault(waiting, {None: waiting})

    def _enter(self, row: dict, token: int) -> tuple[bytes, dict]:
        data = row[None] + self.token[token]
        at = begun = 0
        expected = ""
        while at < len(data):
            after = self.UTF8.get((expected, data[at]))
            if after is None:  # no UTF-8: what was begun ends here; a byte that can't begin anything goes alone
                at += not expected
                expected, begun = "", at
                continue
            at += 1
            expected = after
            if not expected:
                begun = at
        if self.kept >= KEPT_DECODER_STEPS:
            for known in self.rows.values():
                known.clear()
            self.rows.clear()
            self.kept = 0
            return data[:begun], self._row(data[begun:])
        self.kept += 1
        row[token] = step = (data[:begun], self._row(data[begun:]))
        return step

    def feed(self, ids: Iterable[int]) -> bytes:
        """The whole characters that ``ids`` complete, in UTF-8."""
        row = self._row(self.waiting)
        out = []
        for i in ids:
            step = row.get(i)
            whole, row = step if step is not None else self._enter(row, i)
            out.append(whole)
        self.waiting = row[None]
        return b"".join(out)

    def end(self) -> bytes:
        """What still waits; the next text begins."""
        rest, self.waiting = self.waiting, b""
        return rest

    def texts(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text as it completes, for parts of one sequence of ids."""
        for ids in parts:
            yield self.feed(ids).decode("utf-8", "replace")
        yield self.end().decode("utf-8", "replace")


class ByteBpe:
    """Encodes and decodes by a rank file, as its library does without special tokens."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.transducer = Transducer(self.ranks)
        self.decoder = StreamDecoder(self.ranks.token)
        self.decimal = [str(i) for i in range(len(self.ranks.token))]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.young_bytes = 0

    def _ids(self, found: list[str]) -> list[int]:
        if self.young_bytes > KEPT_WORD_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        young = self.young
        ids = list(map(young.get, found))
        if None in ids:
            for i in [i for i, known in enumerate(ids) if known is None]:
                word = found[i]
                known = young.get(word) or self.old.get(word)
                if known is None:
                    known = tuple(self.transducer.encode(word.encode("utf-8")))
                if len(word) <= LONGEST_KEPT and word not in young:
                    young[word] = known
                    self.young_bytes += 4 * len(word) + WORD_COST
                ids[i] = known
        return list(chain.from_iterable(ids))

    def parts(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, a piece of it at a time; none for null."""
        for found in words(text or ""):
            yield self._ids(found)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decoder.feed(ids) + self.decoder.end()


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector of cycles, which would go through all that an encoder keeps again and again; what it throws away has none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_loaded: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of a rank file, loaded once a worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_column(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with column ``to``: the ids of ``text`` as array<int>.

    Null and empty texts have no ids (an empty array). Row by row, so ties, repeated rows and empty
    tables need nothing special. A column already named ``to`` is replaced.
    """
    names = [c for c in docs.columns if c != to]
    held = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + f", `{to}` array<int>"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in rows:
            at = 0
            for texts in slices(batch.column(names.index(text)), SLICE_BYTES):
                with _uncollected():
                    ids = pa.array([bpe.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns), ids], names=[*names, to])
                at += len(texts)

    return held.mapInArrow(batches, schema)


def decode_column(coded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with column ``to``: the bytes that ``ids`` (array<int>) stand for; null ids give null, no ids empty bytes. A column named ``to`` is replaced."""
    names = [c for c in coded.columns if c != to]
    held = coded.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + f", `{to}` binary"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in rows:
            made = [None if x is None else bpe.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*names, to])

    return held.mapInArrow(batches, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 of every row's whole text.

    Encodes the text, hashes the ids, decodes them as a stream and hashes the bytes. Null and empty texts give 0
    tokens and the hash of nothing twice. One row per row, in no order; only doc_id and text are read.
    A text goes through in pieces, so a very long one needs little beside itself.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        decimal = bpe.decimal.__getitem__
        for batch in rows:
            counts, coded, decoded = [], [], []
            for texts in slices(batch.column(1), SLICE_BYTES):
                with _uncollected():
                    for text in texts.to_pylist():
                        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                        for ids in bpe.parts(text):
                            of_ids.update(((" " if n else "") + " ".join(map(decimal, ids))).encode())
                            of_bytes.update(bpe.decoder.feed(ids))
                            n += len(ids)
                        of_bytes.update(bpe.decoder.end())
                        counts.append(n)
                        coded.append(of_ids.hexdigest())
                        decoded.append(of_bytes.hexdigest())
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text")).mapInArrow(batches, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
