import zlib

import numpy as np

from pyspark.sql import functions as F

from subtide.llm import langid


def slow_profile(text, dims):
    codes, last = [0], 0
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or last:
            codes.append(code)
        last = code
    if last:
        codes.append(0)
    total = np.zeros(dims)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += np.roll(langid.letter_vector(a, dims), 2) * np.roll(langid.letter_vector(b, dims), 1) * langid.letter_vector(c, dims)
    return total


def test_profiles_equal_a_plain_sum(monkeypatch):
    texts = ["the cat sat on the mat", "", "123 !!", "a", "Straße, été; ñandú", "中文 text 한글", "x" * 50 + " y" * 50]
    for chars, grams in ((1 << 18, 4096), (7, 3)):
        monkeypatch.setattr(langid, "PIECE_CHARS", chars)
        monkeypatch.setattr(langid, "BLOCK_GRAMS", grams)
        got = langid.profiles(texts, 256)
        for row, text in zip(got, texts):
            assert np.array_equal(row, slow_profile(text, 256)), text


def docs(spark):
    words = {"en": "the and of with this that from are for you", "de": "der und die nicht mit ist ein auch sich den", "fr": "les des une dans pour que qui sur avec est"}
    rows = []
    for i in range(120):
        lang = ["en", "de", "fr"][i % 3]
        w = words[lang].split()
        rows.append((i, " ".join(w[(i * k) % 10] for k in range(1, 12)), lang, "x"))
    rows += [(200, None, "en", "x"), (201, "", "de", "x"), (202, "12 !!", None, "x"), (None, "the and of with this", None, "x"), (5, "der und die nicht", "de", "x"), (203, "the and of " * 30_000, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_edges(spark):
    df = docs(spark)
    rows = langid.identify(df).collect()
    assert len(rows) == df.count()
    truth = {r["doc_id"]: r["lang"] for r in df.collect() if r["doc_id"] is not None and r["doc_id"] < 200}
    for r in rows:
        d = r["doc_id"]
        assert r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if d in (200, 201, 202):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif d in truth and d != 5 and r["held_out"]:
            assert r["lang_pred"] == truth[d]
        elif d == 203 or d is None:
            assert r["lang_pred"] == "en"


def test_nothing_to_learn_from(spark):
    df = docs(spark)
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
