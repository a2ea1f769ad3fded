"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from its letters' vectors, each
rolled by its place in the n-gram, by multiplication; a text's profile bundles (sums) its n-grams'
vectors; a language's prototype bundles its training texts. A text is given the language whose
prototype has the greatest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIMS = 1024
N = 3
SEED = 20240101
#: Characters of text taken at a time, and n-grams whose vectors are held at a time: what a task needs besides its rows.
PIECE_CHARS = 1 << 18
BLOCK_GRAMS = 4096
#: Texts profiled together.
TOGETHER = 128

UNKNOWN = "und"
_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For each code point: is it a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vector(code: int, dims: int = DIMS) -> np.ndarray:
    """The +1/-1 vector of a letter, the same on every worker; 0 stands for any run of other characters."""
    found = _vectors.get(code)
    if found is None or len(found) != dims:
        found = _vectors[code] = np.random.default_rng([SEED, code]).integers(0, 2, dims, dtype=np.int8) * 2 - 1
    return found


def gram_vectors(grams: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Bound vectors (float32, one row each) of n-grams given as rows of N code points."""
    out = None
    for k in range(N):
        codes, where = np.unique(grams[:, k], return_inverse=True)
        rolled = np.stack([np.roll(letter_vector(int(c), dims), N - 1 - k) for c in codes])[where]
        out = rolled if out is None else out * rolled
    return out.astype(np.float32)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text in pieces, runs of non-letters as one 0, with 0 at both ends of the text.

    Pieces overlap by N - 1 places so that every n-gram lies in exactly one.
    """
    letters, tail = letter_table(), np.zeros(1, np.uint32)
    for at in range(0, len(text), PIECE_CHARS):
        codes = np.frombuffer(text[at : at + PIECE_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate((tail, np.where(letters[codes], codes, 0)))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        keep[: len(tail)] = True
        codes = codes[keep]
        yield codes
        tail = codes[-(N - 1) :]
    if len(tail) and tail[-1] != 0:
        yield np.concatenate((tail[-(N - 1) :], np.zeros(1, np.uint32)))


def profiles(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """A row per text of whole numbers in float32, exact below 2**24."""
    out = np.zeros((len(texts), dims), np.float32)

    def add(pieces: list[np.ndarray], owners: list[int]) -> None:
        codes = np.concatenate(pieces)
        owner = np.repeat(np.array(owners), [max(0, len(p) - N + 1) for p in pieces])
        if not len(owner):
            return
        alphabet = np.unique(codes)
        small = np.searchsorted(alphabet, codes).astype(np.int64)
        key = np.zeros(len(codes) - N + 1, np.int64)
        for k in range(N):
            key = key * len(alphabet) + small[k : len(small) - N + 1 + k]
        starts = np.cumsum([0] + [len(p) for p in pieces])[:-1]
        inside = np.concatenate([np.arange(s, s + max(0, len(p) - N + 1)) for s, p in zip(starts, pieces)])
        grams, where = _present(key[inside], len(alphabet) ** N)
        for low in range(0, len(grams), BLOCK_GRAMS):
            block = grams[low : low + BLOCK_GRAMS]
            letters = np.stack([alphabet[block // len(alphabet) ** (N - 1 - k) % len(alphabet)] for k in range(N)], axis=1)
            mine = (where >= low) & (where < low + len(block))
            counts = np.bincount(owner[mine] * len(block) + where[mine] - low, minlength=len(texts) * len(block)).reshape(len(texts), -1)
            np.add(out, counts.astype(np.float32) @ gram_vectors(letters, dims), out=out)

    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= PIECE_CHARS:
                add(held, owners)
                held, owners, size = [], [], 0
    if held:
        add(held, owners)
    return out


def _present(keys: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(keys, return_inverse=True)``, by counting where the space of keys is small."""
    if space > 1 << 21:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(space, bool)
    seen[keys] = True
    grams = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    return grams, place[keys]


def train(docs: DataFrame, dims: int = DIMS) -> list[tuple[str, np.ndarray]]:
    """The prototype of every non-null ``lang``: the sum of its texts' profiles, sorted by language.

    Tasks send a partial sum per language; what reaches the driver is ``dims`` numbers a language. A
    language without any letters in its texts has no prototype.
    """

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in rows:
            for at in range(0, batch.num_rows, TOGETHER):
                by_lang: dict[str, list[str]] = {}
                for text, lang in zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns)):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    total = sums.setdefault(lang, np.zeros(dims, np.int64))
                    # As one text to the profile: which text an n-gram is from doesn't matter here.
                    total += profiles(["\n".join(texts)], dims)[0].astype(np.int64)
        for lang in sorted(sums):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([sums[lang]], pa.list_(pa.int64()))], names=["lang", "profile"])

    parts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(partial, "lang string, profile array<bigint>")
    summed = parts.select("lang", F.posexplode("profile").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p")).collect()
    found = [(r["lang"], np.array([x["x"] for x in r["p"]], np.float64)) for r in rows]
    return sorted((lang, p) for lang, p in found if p.any())


def predict(docs: DataFrame, prototypes: list[tuple[str, np.ndarray]], keep: list[str], dims: int = DIMS) -> DataFrame:
    """``keep`` columns, lang_pred and score (the cosine with that language's prototype, 0 at least) of every row.

    Only ``text`` enters a prediction. A null text, one without letters, and any text where there are
    no prototypes are ``und`` with score 0. Of equal cosines the language that sorts first wins.
    """
    langs = [lang for lang, _ in prototypes]
    matrix = np.stack([p / np.linalg.norm(p) for _, p in prototypes]).astype(np.float32) if prototypes else np.zeros((0, dims), np.float32)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in rows:
            pred, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for at in range(0, batch.num_rows, TOGETHER):
                own = [t or "" for t in batch.column(text_at).slice(at, TOGETHER).to_pylist()]
                sums = profiles(own, dims)
                norms = np.linalg.norm(sums, axis=1)
                cosines = (sums @ matrix.T) / np.where(norms > 0, norms, 1)[:, None]
                for i, t in enumerate(own):
                    if langs and norms[i] > 0 and _has_letter(t, letters):
                        best = int(cosines[i].argmax())
                        pred[at + i], score[at + i] = langs[best], float(min(1.0, max(0.0, cosines[i, best])))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    # The text crosses to Python once, also if it is among the columns to keep.
    sent = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    text_at = sent.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[: len(keep)])
    return sent.mapInArrow(batches, f"{schema}, lang_pred string, score double")


def _has_letter(text: str, letters: np.ndarray) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(letters[np.frombuffer(text[i : i + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)].any() for i in range(0, len(text), PIECE_CHARS))


def held_out() -> object:
    """True for the documents that a prediction's quality is measured on: crc32 of the doc_id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents not held out, predicted for all."""
    prototypes = train(docs.where(~held_out()), dims)
    return predict(docs.withColumn("held_out", held_out()), prototypes, ["doc_id", "held_out"], dims)
