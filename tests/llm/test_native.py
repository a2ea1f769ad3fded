"""Sharding, URL filter and decontamination on small tables, against plain Python."""

import re
import zlib

import pytest

from subtide.llm import decontaminate, queries, sharding, url_filter


def test_shards(spark):
    rows = [(i % 40, "x" * (i * 7 % 50), "keep") for i in range(200)] + [(None, None, None), (3, "é" * 10_000, "k"), (7, "", "k"), (7, "", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string").repartition(5)
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    sizes = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sizes
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    last = -2
    for k in sorted(by):
        own = sorted(by[k], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in own]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    small = [x for x in rows if x[0] != 3]
    even = sharding.shard_documents(spark.createDataFrame(small, df.schema).repartition(3), 4).collect()
    total, most = sum(r["size"] for r in even), max(r["size"] for r in even)
    for k in range(4):
        assert abs(sum(r["size"] for r in even if r["shard"] == k) - total / 4) <= most
    assert sharding.shard_documents(df.limit(0)).count() == 0
    wide = sharding.byte_shards(df.selectExpr("doc_id AS id", "CAST(0 AS INT) AS shard", "CAST(NULL AS INT) AS s"), "s", ["id"], 3)
    assert wide.columns == ["id", "s", "shard", "slot"] and {r["shard"] for r in wide.collect()} == {0}


RULES = [("com", "/en/", "block", True), ("example.com", "/en/7", "allow", True), ("Example.NET", "/de/8", "block", True), ("net", "/de/", "allow", True), ("net", "/de/", "allow", True), (None, "/", "block", True), ("spam.org", "/", "block", False), ("spam.org", "/ok", "allow", True)]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(ranked, len(h) + len(p), v, h + p) for h, p, v, ranked in RULES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(False, 0, "allow", None))
    return host, path, best[3] if best[0] else None, best[2]


URLS = [None, "", "no scheme", "http://", "http://example.com", "https://WWW.Example.COM/en/712?x#y", "http://a.b.example.com/en/8", "ftp://x.net/de/8", "ftp://y.example.net/de/88", "http://spam.org/a", "http://m.spam.org/ok/1", "http://spam.org", "http://notspam.org/a", "http://com/en/", "a://É.com/en/\n7#", "x://u://v.com/en/1", "http://" + "a." * 300 + "com/en/" + "z" * 5000]


@pytest.mark.parametrize("few", [True, False])
def test_urls(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 1)
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)] + [(0, None, "v")], "page_id bigint, url string, verdict string")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string, ranked boolean")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] and r["rule"].lower(), r["verdict"]) for r in url_filter.judge_urls(pages, listed, n_blocks=8).collect() if r["page_id"] or r["host"] == "")
    want = sorted([(i, *by_hand(u)[:2], by_hand(u)[2] and by_hand(u)[2].lower(), by_hand(u)[3]) for i, u in enumerate(URLS)] + [(0, "", "", None, "allow")])
    assert got == want
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


def test_listed_sites_under_every_domain(spark, tmp_path):
    sites = [f"{h}{s}.example.{t}" for s in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for t in ("com", "net", "org") for h in ("", "m.")]
    rows = [(i, f"http://{s}/x/{i}") for i, s in enumerate(sites)] + [(100, "http://not-spam-farm.example.org/x"), (101, "http://spam-farm.example.com/en/7")]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (None, "block") for i in range(len(sites))} | {100: (None, "allow"), 101: ("example.com/en/7", "allow")}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item here"), (2, "short item here"), (30, "Ünï cödé! short"), (4, None), (5, "!!"), (10, "a b c d e f g h i j k l"), (None, "nobody knows this one")]
DOCS = [(1, "x y one two THREE four, five six seven eight nine ten eleven z"), (2, "one two three four five six seven eight nine"), (3, "A short item here and a short item here"), (3, "A short item here and a short item here"), (4, None), (5, ""), (6, "ÜNï cödé short"), (7, "Ünï CÖDÉ short ünï cödé short"), (8, "w " * 30_000 + "a-b-c-d-e-f-g-h-i-j-k-l"), (None, "nobody knows this one"), (9, "clean words only")]


def expected(text):
    w, hit, ids = words(text), set(), set()
    for item, t in ITEMS:
        iw = words(t)
        n = min(10, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if item is not None:
                    ids.add(str(item))
    return len(w), sorted(i + 1 for i in hit), sorted(ids)


@pytest.mark.parametrize("few", [True, False])
def test_contamination(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontaminate, "SET_WINDOWS", 2)
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 2)
    docs = spark.createDataFrame([(d, t, "old") for d, t in DOCS], "doc_id bigint, text string, items string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], list(r["hit_pos"]), list(r["items"])) for r in decontaminate.hit_windows(docs, bench, keep=["doc_id"]).collect()), key=repr)
    assert got == sorted(((d, *expected(t)) for d, t in DOCS), key=repr)
    flags = {(r["doc_id"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert flags == {(d, bool(expected(t)[1])) for d, t in DOCS}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 9]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {False}


def test_cut_spans(spark):
    docs = spark.createDataFrame([(1, "Keep THIS. Short item, here! And this."), (2, "Clean."), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "short item here")], "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, bench).collect()}
    assert got == {1: "Keep THIS. And this.", 2: "Clean.", 3: None}
