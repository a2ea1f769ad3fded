import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from tests_llm_helpers import brute, shingle_set

from subtide.llm import jaccard_join as j, shingles
from subtide.llm.components import connected_components

def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, source, passage = [], prose(120), prose(60)
    for i in range(70):  # near copies about the threshold
        w = list(source)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append(" ".join(w))
    rows += [" ".join(prose(30) + passage + prose(r.randint(0, 40))) for _ in range(30)]  # a shared passage
    rows += [" ".join(passage[: r.randint(50, 60)]) for _ in range(20)]
    rows += [" ".join(prose(r.randint(1, 80))) for _ in range(60)]
    rows += [rows[3].upper(), rows[3].replace(" ", " \t\n"), "one two", "One  TWO", "one two three", "", None, " \n", "É a b c d", "é a b c d"]
    r.shuffle(rows)
    rows = [(7 * i % 1009, t) for i, t in enumerate(rows)]
    long = prose(60_000)
    near = [*long[:59_000], *prose(1000)]
    return rows + [(2000, " ".join(long)), (2001, " ".join(near)), (2001, " ".join(near)), (None, " ".join(long)), (2002, rows[0][1]), (2002, rows[1][1])]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("CHUNK_TOKENS", 2000), ("GROUP_DOCS", 4), ("GROUP_TOKENS", 1500), ("OPEN_GROUPS", 2), ("PIECE_SETS", 5), ("BUCKET_BYTES", 2000), ("HOT_SETS", 3), ("HOT_TOKENS", 40), ("BROADCAST_IDS", 1)):
            monkeypatch.setattr(j, name, value)
        monkeypatch.setattr(shingles, "PIECE", 512)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, n int").repartition(5)
    got = [tuple(r) for r in j.similar_documents(docs).collect()]
    want = brute(rows)
    assert sorted(got, key=repr) == sorted(((d, len(shingle_set(t)), want.get(d)) for d, t in rows), key=repr)
    kept = j.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()} - {None}) == sorted(set(want.values()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert j.similar_documents(docs.limit(0)).count() == 0
    assert sorted(map(tuple, j.similar_documents(docs).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_shingles_do_not_depend_on_the_batch():
    texts = [t for _, t in corpus() if t is None or len(t) < 5000]
    whole = list(shingles.shingle_sets(pa.array(texts)))
    for text, own in zip(texts, whole):
        assert len(own) == len(shingle_set(text))
        assert np.array_equal(own, next(iter(shingles.shingle_sets(pa.array([text], pa.string())))))
    part = pa.array(["x", *texts, None]).slice(1, len(texts))
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(part)))


def test_patterned_words_do_not_fall_together():
    for n in (64, 512, 1024, 2048, 4096, 8192):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        a, b, c, d = shingles.shingle_sets(pa.array([word, other, word.upper(), word + "\0"]))
        assert a != b and a == c and a != d
    words = [f"{p}{i}{q}" for i in range(20_000) for p, q in (("", ""), ("w", ""), ("long", "word" * 3))]
    found = shingles.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8), np.zeros(1, np.int64))[0]
    assert len(set(found.tolist())) == len(set(words)) == len(found)


def test_a_connected_family_opens_no_pairs_beyond_the_chain(spark):
    cells = spark.createDataFrame([(t, g, 10, 10) for t in range(3) for g in range(50)], "token bigint, gid bigint, least bigint, most bigint")
    chain = j.chained_groups(cells, 75)
    assert sorted(map(tuple, chain.collect())) == [(g, g + 1) for g in range(49)]
    members = spark.createDataFrame([(g, g) for g in range(50)] + [(0, 100)], "gid bigint, head bigint")
    apart = lambda x: spark.createDataFrame([(g, g // x) for g in range(101)], "node bigint, component bigint")
    assert j.candidate_groups(cells, members, apart(200), 75).count() == 0
    assert j.candidate_groups(cells, members, apart(50), 75).count() == 49
    assert j.candidate_groups(cells, members.where("head < 100"), apart(25), 75).count() == 25 * 25


def test_group_overlaps():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60_000, n).astype(np.uint64)) for n in (1, 500, 20_000, 20_000)]
    union = np.unique(np.concatenate(sets))
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert j.overlaps(sets, sets, union).tolist() == want


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(5, None), (6, 6)]
    up = collections.defaultdict(set)
    for a, b in edges:
        if b is not None and a != b:
            up[a].add(b)
            up[b].add(a)

    def least(x):
        seen, work = {x}, [x]
        while work:
            for y in up[work.pop()] - seen:
                seen.add(y)
                work.append(y)
        return min(seen)

    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: least(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
