import hashlib
import random
import sys

import pytest
import tiktoken

from subtide.llm import byte_bpe
from subtide.llm.vocabulary import word_bpe_path

PATH = word_bpe_path("byte_bpe_50k.tiktoken")
ODD = ["a", "th", "in", "ing", "'s", "'LL", "'ll", "é", "é", "İ", "Σ", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "​", "　", "1", "½", "²", "中文", "한글", "👍", "👍🏽", "!", "...", "<|endoftext|>", "%%", "\0", "ﬁ", "˘", "Ⅷ", "͸", "೜", "₏", "\U000323b0", "￿", "_", "-"]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.Ranks(PATH).rank
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(2500)]
    made += ["".join(r.choice("abcdeinrstTHE ") for _ in range(r.randint(1, 300))) for _ in range(300)]
    made += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(300)]
    return [*made, "", "a" * 5000, " " * 700 + "x", "=" * 3000, "\n" * 300, "ab" * 3000, "é" * 2000]


def test_ids_and_bytes_equal_the_librarys(library):
    own = byte_bpe.ByteBpe(PATH)
    for t in texts():
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t)
        assert own.decode(ids) == library.decode_bytes(ids) == t.encode()


def test_small_bounds_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_STATES", 40)
    monkeypatch.setattr(byte_bpe, "KEPT_SEAMS", 10)
    monkeypatch.setattr(byte_bpe, "KEPT_WORD_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "KEPT_DECODER_STEPS", 7)
    monkeypatch.setattr(byte_bpe, "LONGEST_KEPT", 5)
    monkeypatch.setattr(byte_bpe, "PIECE", 9)
    own = byte_bpe.ByteBpe(PATH)
    for t in texts()[::3]:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    assert len(own.transducer.states) <= 41 and len(own.ranks._fits) <= 10 and own.decoder.kept <= 7


def test_every_pair_of_short_words_and_every_token(library):
    own = byte_bpe.ByteBpe(PATH)
    r = random.Random(3)
    tokens = own.ranks.token
    for rank in range(0, len(tokens), 7):
        assert own.transducer.encode(tokens[rank]) == [rank]
    for _ in range(4000):  # bytes that need not be UTF-8
        word = tokens[r.randrange(len(tokens))] + tokens[r.randrange(len(tokens))] + tokens[r.randrange(256)]
        assert own.transducer.encode(word) == library._encode_single_piece(word)


def test_tokens_go_out_after_a_bounded_lookahead():
    own = byte_bpe.ByteBpe(PATH)
    longest = max(map(len, own.ranks.token))
    for word in (b"abababab" * 400, b"the quick brown fox" * 90, b"=" * 4000):
        state, read, out = own.transducer.start, 0, 0
        for byte in word:
            state, tokens = own.transducer._step(state, byte)
            read += 1
            out += sum(len(own.ranks.token[t]) for t in tokens)
            assert read - out <= 2 * longest


def test_a_stream_gives_characters_as_they_complete():
    own = byte_bpe.ByteBpe(PATH)
    text = "naïve 👍🏽 中文 ೜ end"
    ids = own.encode(text)
    seen = list(own.decoder.texts([i] for i in ids))
    assert "".join(seen) == text and "�" not in "".join(seen)
    r = random.Random(9)
    for _ in range(3000):
        some = [r.randrange(256) if r.random() < 0.9 else r.randrange(50_000) for _ in range(r.randint(1, 12))]
        data = b"".join(own.ranks.token[i] for i in some)
        assert "".join(own.decoder.texts([i] for i in some)) == data.decode("utf-8", "replace")
        assert own.decode(some) == data


def test_rows(spark, library):
    rows = [(1, "The cat", "x"), (1, "The cat", "x"), (2, None, "x"), (3, "", None), (None, "a<|endoftext|>b", "y"), (4, "word  " * 40_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids_sha256 string")
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.round_trip(df, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip(df.limit(0), PATH).count() == 0
    df = df.withColumnRenamed("ids_sha256", "ids")
    back = byte_bpe.decode_column(byte_bpe.encode_column(df, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in back) == sorted((d or 0, t or "") for d, t, _ in rows)
    none = byte_bpe.decode_column(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).collect()
    assert none[0]["decoded"] is None


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_documents(spark, library, sf):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    for r in byte_bpe.round_trip(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), PATH).collect():
        ids = library.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_words_of_a_long_text_do_not_recurse():
    assert sys.getrecursionlimit() < 100_000
    own = byte_bpe.ByteBpe(PATH)
    assert own.decode(own.encode("q" * 300_000)) == b"q" * 300_000
