"""Run matching against the rule row by row: chains, shared keys, components over many tasks."""

import random
import time

import pytest

from subtide.operators import runs as r

KIND = "no bigint, hash string, media_type string, title string, season int, episode int, stages array<string>"


def greedy(before, after):
    by_hash = {a[1]: a for a in after if a[1]}
    by_id = {a[2:6]: a for a in after if a[2] and a[3]}
    used, out = set(), []
    for b in sorted(before):
        h, i = by_hash.get(b[1]) if b[1] else None, by_id.get(b[2:6]) if b[2] and b[3] else None
        for how, a in (("hash", h), ("identity", i)):
            if a and a[0] not in used:
                excluded = b[6] is not None and a[6] is not None and b[6] != a[6]
                if not excluded:
                    used.add(a[0])
                out.append((b[0], a[0], how, excluded))
                break
    return out


def video(no, h, title, stages=("x",)):
    return (no, h, "tv", title, 1, None, list(stages))


def matched(spark, before, after):
    return sorted(map(tuple, r.match_runs(spark.createDataFrame(before, KIND).repartition(3), spark.createDataFrame(after, KIND)).collect()))


def chain(n):
    """The first two want the same hash; each identity that is then taken was the next one's hash."""
    return [video(0, "h0", "t0")] + [video(k + 1, f"h{k}", f"t{k + 1}") for k in range(n)], [video(k, f"h{k}", f"t{k}") for k in range(n + 1)]


@pytest.mark.parametrize("steps", [1 << 19, 37])
def test_a_chain_of_a_thousand(spark, monkeypatch, steps):
    monkeypatch.setattr(r, "STEPS_A_TASK", steps)
    n = 1000 if steps > 1000 else 150
    before, after = chain(n)
    began = time.time()
    got = matched(spark, before, after)
    took = time.time() - began
    assert got == greedy(before, after) and sum(x[2] == "identity" for x in got) == n
    assert steps < 1000 or took < 30


def test_random_runs_equal_the_rule(spark):
    rnd = random.Random(4)
    for size, keys in ((12, 4), (60, 20), (300, 60), (400, 400)):
        name = lambda p: rnd.choice([None, "", *[f"{p}{k}" for k in range(keys)]])
        made = lambda n: [(no, name("h"), rnd.choice(["tv", "tv", None]), name("t"), rnd.choice([None, 1]), 1, rnd.choice([["x"], ["x"], ["y"], None])) for no in rnd.sample(range(5 * n), n)]
        before, after = made(size), made(size)
        after.sort()
        assert matched(spark, before, after) == greedy(before, after)


def test_a_hot_hash_takes_no_rounds(spark):
    before = [video(k, "hot", f"t{k % 40}") for k in range(2000)]
    after = [video(0, "hot", "t0")] + [video(k, None, f"t{k}") for k in range(1, 40)]
    assert matched(spark, before, after) == greedy(before, after)


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(r, "LINKS_A_TASK", 16)
    rnd = random.Random(8)
    names = rnd.sample(range(1000), 300)
    links = [(names[k], names[k + 1]) for k in range(149)] + [(names[k], names[150 + rnd.randrange(5)]) for k in range(155, 300)]
    up = {x: x for x in names}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        up[max(top(u), top(v))] = min(top(u), top(v))
    rnd.shuffle(links)
    got = dict(map(tuple, r.link_components(spark.createDataFrame([*links, (5, 5)], "u bigint, v bigint").repartition(7)).collect()))
    for u, v in links:
        assert got.get(u, u) == got.get(v, v)
    parts = {}
    for x in {n for link in links for n in link}:
        parts.setdefault(top(x), set()).add(got.get(x, x))
    assert all(len(p) == 1 for p in parts.values()) and len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_empty_runs(spark):
    assert matched(spark, [], [video(1, "h", "t")]) == [] == matched(spark, [video(1, "h", "t")], [])
