"""Words that are one token are looked up, not walked through."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from subtide.llm import bpe, token_files
from subtide.llm.vocabulary import word_bpe_path


def test_whole_words_need_no_matches(monkeypatch):
    b = bpe.WordBpe(word_bpe_path())
    token = next(s for s in ("the </w>", "the", "and", "of") if b.automaton.get(s + bpe._END, None) is not None)
    walked = b.encode_words([token, token + token + "qzx"])

    def none(*_):
        raise AssertionError("matches were looked up for a whole word")

    monkeypatch.setattr(b, "_matches", none)
    assert b.encode_words([token]) == walked[:1] and len(walked[0]) == 4


def test_the_longest_tokens_are_taken_in_one_pass(monkeypatch):
    """A word of several tokens whose longest ones fit needs no list of all matches; what the pass takes is what the walk would, and the library's ids come out."""
    b = bpe.WordBpe(word_bpe_path())
    rnd = random.Random(5)
    pieces = [s.removesuffix(bpe.END_OF_WORD) for s in b.cutter.library.get_vocab() if s.isascii() and s.removesuffix(bpe.END_OF_WORD).isalpha()]
    words = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6))).lower() for _ in range(3000)] + ["".join(rnd.choice("abcdeąéß") for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    want = [np.array(b.cutter.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert b.encode_words(words) == want
    whole = []
    for word in words[:3000]:
        symbols = word + bpe._END
        out, covered = b._greedy(symbols)
        at = 0
        for token in out:
            assert token == b._matches(symbols, at, at + 1)[0][-1]
            at += b.length[token]
        if covered == len(symbols) and len(out) > 1:
            whole.append(word)
    monkeypatch.setattr(b, "_matches", None)
    assert len(whole) > 100 and b.encode_words(whole) == [want[words.index(w)] for w in whole]


def test_words_go_to_the_library_with_blanks_between(monkeypatch):
    """Word ends are told by the tokens; where those don't add up, by a special token between words. Both give the ids of each word by itself."""
    words = ["the", "qzxqzx", "</", "w", ">", "'s", "7", "ą́b", "…", "́x", "naïve", "\x00\x01"]
    library = bpe.WordBpe(word_bpe_path()).cutter.library
    want = [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    joined = []
    for end in (token_files.END_OF_WORD, "no such end"):
        monkeypatch.setattr(token_files, "END_OF_WORD", end)
        monkeypatch.setattr(token_files, "_loaded", {})
        ids = token_files.library_ids(word_bpe_path())
        joined.append(ids.encode([*words, *ids.cutter.special]))
    assert joined[0] == joined[1] and joined[0][: len(words)] == want


def test_wide_slices_cut_shared_chunks_once():
    """Texts of one wide slice share their chunks; the ids are those of narrow slices."""
    b = bpe.WordBpe(word_bpe_path())
    texts, cut = pa.array(["alpha beta, gamma-delta " * 400] * 6), []
    narrow = [x.tobytes() for x in b.word_ids(1 << 12).of_texts(texts)]
    plain = b.cutter.cut
    b.cutter.cut = lambda chunks: cut.extend(chunks) or plain(chunks)
    assert [x.tobytes() for x in b.word_ids(bpe.WIDE_SLICE_BYTES).of_texts(texts)] == narrow
    assert len(cut) == len(set(cut))


def test_words_of_letters_are_only_merged_by_the_library(monkeypatch):
    """They come normal, lower-cased and cut, so the library's own normalizing and cutting sees none of them; other words do go there."""
    seen = []

    class Spy:
        def __init__(self, inner):
            object.__setattr__(self, "inner", inner)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **options):
            seen.append((self.inner.normalizer is not None, texts[0].split(" ")))
            return self.inner.encode_batch_fast(texts, **options)

    class Loads:
        from_file = staticmethod(lambda path: Spy(Tokenizer.from_file(path)))

    monkeypatch.setattr(token_files, "Tokenizer", Loads)
    monkeypatch.setattr(token_files, "_loaded", {})
    texts = ["The naïve Łódź, 'tis ﬁne: ΣΑΣ x² İstanbul 中文字 ѣ<|endoftext|>ab_c 12", "áb ǆ ᾴ 가 ℌ Å"]
    library = Tokenizer.from_file(word_bpe_path())
    got = [x.tolist() for x in token_files.library_ids(word_bpe_path()).of_texts(pa.array(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    whole = [w for full, words in seen if full for w in words]
    assert {"'t", ",", "1", "2"} <= set(whole) and not [w for w in whole if w.isalpha()]
