import random
import re
from collections import Counter, defaultdict

import pytest

from subtide.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    count, lang_count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOW) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        lang_count[lang].update(terms)
        in_docs[lang].update(set(terms))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in in_docs.items()}

    def prices(c, lang):
        v = len(kept[lang])
        total = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept[lang]}

    p = {g: prices(count[g], g[0]) for g in groups}
    q = {lang: prices(c, lang) for lang, c in lang_count.items()}
    out = []
    for g in groups:
        lang = g[0]
        pairs = [(-sum(abs(p[g][t] - p[h][t]) for t in kept[lang]), h[1].encode(), h[1]) for h in groups if h[0] == lang and h != g]
        terms = [(q[lang][t] - p[g][t], t.encode(), t) for t in kept[lang] if count[g][t] and p[g][t] > q[lang][t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(*g, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)]
    return sorted(out)


def made():
    r = random.Random(2)
    words = ["The", "the", "cat", "été", "ÉTÉ", "x1y", "naïve", "中文", "dog", "a\x85b", "\xa0", "O'Neil", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for _ in range(400):
        source = r.choice(["hot", "hot", "hot", "s1", "s2", None, "", "é"])
        weights = [1 + (hash_of(source, w) % 7) for w in words]
        rows.append((" ".join(r.choices(words, weights, k=r.randint(0, 40))), r.choice(["en", "en", "fr", None, ""]), source))
    rows += [rows[0]] * 40 + [(None, "en", "s1"), (None, None, None), ("", "fr", "quiet"), ("only here", "rare", "s1"), (None, "rare", "s2"), ("the cat " * 3000, "en", "long")]
    return rows


def hash_of(source, word):
    return sum(map(ord, (source or "") + word))


@pytest.mark.parametrize(("min_docs", "top", "columns", "terms"), [(30, 50, 1024, 1024), (3, 4, 7, 3), (1, 50, 64, 1024)])
def test_against_brute_force(spark, monkeypatch, min_docs, top, columns, terms):
    monkeypatch.setattr(divergence, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    rows = made()
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "text string, lang string, source string, value int, term string").repartition(3)
    got = sorted(map(tuple, divergence.audit(df, min_docs, top).collect()))
    assert got == brute(rows, min_docs, top)
    assert {g[2] for g in got} == {"pair", "term"}


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    whole = divergence.term_counts(df).count()
    monkeypatch.setattr(divergence, "HELD_COUNTS", 20)
    parted = divergence.term_counts(df)
    assert parted.count() > whole
    assert sorted(map(tuple, divergence.audit(df, 3, 9).collect())) == brute(rows, 3, 9)


def test_joint_tables_count_terms(spark):
    cells = [("en", "a", 9, [("x", 2), ("y", 1)]), ("en", "b", 9, [("x", 2), ("y", 1), ("z", 5)]), ("en", "c", 4, [("y", 3)]), ("fr", "a", 3, [("y", 1), ("x", 2)])]
    df = spark.createDataFrame(cells, "lang string, term string, n bigint, cells array<struct<source:string,n:bigint>>")
    got = sorted(map(tuple, divergence.joint_tables(df).collect()))
    assert got == [("en", "x", 2, "y", 1, 2), ("en", "x", 2, "z", 5, 1), ("en", "y", 1, "z", 5, 1), ("fr", "x", 2, "y", 1, 1)]


def test_prices_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, 0, 0), (7, 100, 3), (10**13, 3 * 10**13 + 1, 10**6)], "level bigint, total bigint, kept bigint")
    got = [r[0] for r in df.select(divergence.price("level", "total", "kept")).collect()]
    assert got == [0, 1 + 10**9 * 12 // 115, 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 1 + 5 * 10**6)]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(none).count() == 0
    one = spark.createDataFrame([("a b", "en", "s"), ("a", "en", "t")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(one).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
