import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from subtide.llm import bpe, token_files, words
from subtide.llm.vocabulary import word_bpe_path

ODD = ["a", "th", "in", "ing", "'s", "'LL", "é", "é", "İ", "Σ", "ς", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "​", "1", "½", "中文", "한글", "👍", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "%%", "\0", "ﬁ", "Ᲊ", "ᲊ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe_path())


def texts():
    r = random.Random(7)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(800)]
    made += ["".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 300))) for _ in range(150)]
    return [*made, "", "a" * 9000, "ab" * 5000, "x" * 4097 + " " + "!" * 4095]


def test_encodings_equal_the_librarys(library):
    own = bpe.encoder(word_bpe_path())
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert b"".join(bpe.decoded_parts(own, own.encode(t))).decode() == library.decode(ids, skip_special_tokens=False)


def test_a_batch_in_slices_equals_the_librarys(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 300)
    monkeypatch.setattr(words, "BLOCK_CHUNKS", 5)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 50)
    monkeypatch.setattr(token_files, "SLICE_BYTES", 300)
    monkeypatch.setattr(token_files, "CALL_WORDS", 7)
    monkeypatch.setattr(token_files, "_loaded", {})
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    made = [None, *texts(), None]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in made]
    for ids in (token_files.library_ids(word_bpe_path()), bpe.encoder(word_bpe_path()).word_ids()):
        assert [x.tolist() for x in ids.of_texts(pa.array(["x", *made]).slice(1))] == want
        assert list(ids.of_texts(pa.array([], pa.string()))) == []
    assert len(token_files.library_ids(word_bpe_path()).old) <= 50 + max(len(t or "") for t in made)


def test_merging_by_rank_gives_the_same_ids(library):
    own = bpe.WordBpe(word_bpe_path())
    r = random.Random(11)
    for _ in range(300):
        symbols = [r.choice("aehinrst") for _ in range(r.randint(1, 40))]
        vocab = library.get_vocab()
        parts = [vocab[c] for c in symbols[:-1]] + [vocab[symbols[-1] + bpe.END_OF_WORD]]
        while True:
            ranked = [(own.merged[a * own.size + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a * own.size + b in own.merged]
            if not ranked:
                break
            token, i = min(ranked)
            parts[i : i + 2] = [token]
        assert own.encode_symbols("".join(symbols) + " ").tolist() == parts


def test_decoding_in_parts_equals_decoding_at_once(monkeypatch):
    own = bpe.encoder(word_bpe_path())
    ids = own.encode("the cat sat on the mat, twice over")
    monkeypatch.setattr(bpe, "DECODE_IDS", 3)
    assert b"".join(bpe.decoded_parts(own, ids)) == own.decode(ids)


def test_round_trip_rows(spark, library):
    rows = [(1, "The cat", "x"), (1, "The cat", "x"), (2, None, "x"), (3, "", None), (None, "a<|endoftext|>b", "y"), (4, "word " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string")
    got = sorted(map(tuple, bpe.round_trip(df, word_bpe_path()).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        coded = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), coded, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(df.limit(0), word_bpe_path()).count() == 0


def test_encode_column_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "the cat", "old"), (2, None, "old")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df, word_bpe_path()).collect()}
    assert bytes(got[1]) == bpe.encoder(word_bpe_path()).encode("the cat") and bytes(got[2]) == b""


def test_token_files(spark, library, tmp_path):
    rows = [(5, "the cat sat"), (None, "no id"), (3, ""), (3, None), (9, "word " * 3000), (1, "a b c"), (1, "a b c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = str(tmp_path / "tokens")
    got = sorted(map(tuple, token_files.token_file_index(df, word_bpe_path(), 2, path).collect()), key=lambda r: r[1])
    import zlib

    assert [r[0] for r in got] == [None, 1, 1, 3, 3, 5, 9]
    start = 0
    lengths = {}
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        lengths.setdefault(doc_id, []).append((n, crc))
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in lengths[doc_id]
    back = token_files.read_tokens(spark, path).where("doc_id = 5").collect()
    assert [r["ids"] for r in back] == [[*library.encode("the cat sat", add_special_tokens=False).ids, 2]]
    empty = token_files.token_file_index(df.limit(0), word_bpe_path(), 2, str(tmp_path / "none"))
    assert empty.count() == 0
