import hashlib
import random
import zlib

import numpy as np
import pytest

from subtide.llm import merkle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """(root, siblings on each leaf's way up, and the same folded from another leaf), level by level."""
    level, ways = list(leaves), [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(level) > 1:
        for i, way in enumerate(ways):
            run = range(at[i] // 8 * 8, min(at[i] // 8 * 8 + 8, len(level)))
            way.append(([level[j] for j in run if j < at[i]], [level[j] for j in run if j > at[i]]))
            at[i] //= 8
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return (level or [None])[0], ways


def brute(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        tampered = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            tampered = leaf((doc_id, source, lang, n_chars, text and text.translate(LOW)))
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, own), doc_id, own, tampered))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: (sorted(groups[lang], key=lambda x: x[0]), *tree([x[2] for x in sorted(groups[lang], key=lambda x: x[0])])) for lang in langs}
    root, tops = tree([trees[lang][1] for lang in langs])
    out = []
    for lang, above in zip(langs, tops):
        docs, subroot, ways = trees[lang]
        for (_, doc_id, own, tampered), way in zip(docs, ways):
            folded = tampered
            for left, right in [*way, *above]:
                folded = h(*left, folded, *right)
            out.append((doc_id, own, subroot, root, h(*[s for left, right in [*way, *above] for s in (*left, *right)]), folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, g int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)


def made(n, langs):
    r = random.Random(n)
    rows = [(r.randint(0, 3 * n), r.choice(["a", None, ""]), r.choice(langs), r.choice([None, 3]), r.choice([None, "", "Abc", "abc", "É", "Text " * r.randint(1, 50)])) for _ in range(n)]
    return rows + rows[: n // 20] + [(None, None, None, None, None)] * 2 + [(None, "s", "en", 1, "T")]


@pytest.mark.parametrize("n,langs", [(9, ["en"]), (70, ["en", "fr", None, ""]), (1300, ["en", "en", "en", "en", "fr", "中", "é"]), (60, [f"l{i}" for i in range(60)])])
def test_against_plain_python(spark, n, langs):
    rows = made(n, langs)
    got = sorted(map(tuple, merkle.audit(frame(spark, rows).repartition(3)).collect()), key=repr)
    assert got == brute(rows)


def test_deep_trees(spark):
    """Blocks of eight leaves, so that several tiers and several blocks over the groups' roots occur; a run of 513, 64 and 65 too."""
    rows = [(i, "s", "big", i, f"Text {i}") for i in range(513)] + [(i, "s", "full", i, "T") for i in range(64)] + [(i, "s", "over", i, "T") for i in range(65)] + [(1, "s", f"l{i:02}", 1, "x") for i in range(70)]
    assert sorted(map(tuple, merkle.audit(frame(spark, rows).repartition(5), block_height=1).collect()), key=repr) == brute(rows)


def test_few_rows(spark):
    assert merkle.audit(frame(spark, [])).count() == 0
    for rows in ([(1, None, None, None, None)], [(5, "s", "en", 1, "A"), (5, "s", "en", 1, "A")]):
        assert sorted(map(tuple, merkle.audit(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_proofs_fold_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else None, i, f"Text {i}") for i in range(700)]
    leaves = merkle.document_leaves(frame(spark, rows))
    found = merkle.proofs(merkle.build(leaves, ["doc_id"]), ["doc_id"]).collect()
    assert len(found) == 700
    for r in found:
        path = [(s["place"], s["siblings"]) for s in r["path"]]
        assert merkle.fold(r["leaf"], path) == r["root"] and merkle.fold(h("x"), path) != r["root"]


def test_addresses_split_at_half_height():
    assert merkle.address(1, 0, np.arange(1)).tolist() == [0]
    assert merkle.address(2, 1, np.arange(8)).tolist() == list(range(1, 9))
    # Four levels are two of two: the root and its children, then each subtree below as a run.
    assert merkle.address(4, 2, np.arange(3)).tolist() == [9, 18, 27]
    assert merkle.address(4, 3, np.arange(10)).tolist() == [10, 11, 12, 13, 14, 15, 16, 17, 19, 20]
    for height in range(6):
        every = np.concatenate(merkle.addresses(height))
        assert sorted(every.tolist()) == list(range(merkle.size(height + 1)))
