"""The registered queries of this subpackage, each an operator over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subtide.llm import bpe, byte_bpe, decontaminate, divergence, html_extract, jaccard_join, langid, license_scan, media_columns, merkle, pipeline, sharding, token_files, url_filter
from subtide.llm.vocabulary import word_bpe_path
from subtide.session import table, written

#: (host, path, verdict) of the rules; the longest that fits a url wins.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Listed sites, under every top-level domain of the pages: blocked where no rule fits.
URL_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
URL_LIST = [(f"{site}.example.{tld}", "/") for site in URL_SITES for tld in ("com", "net", "org")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(table(spark, sf_dir, "documents"), word_bpe_path(), end_id=2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(h, p, v, True) for h, p, v in URL_RULES] + [(h, p, "block", False) for h, p in URL_LIST]
    listed = spark.createDataFrame(rows, "host string, path string, verdict string, ranked boolean")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), listed)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media_columns.store_texts(table(spark, sf_dir, "documents")), "media")
    return media_columns.media_features(stored)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe_path(), slice_bytes=bpe.WIDE_SLICE_BYTES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe_path("byte_bpe_50k.tiktoken"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH pages_no AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split_at AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM pages_no),
parts AS (
  SELECT n, page_id, coalesce({_LOWER_AZ.format('h')}, '') AS host,
         coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path
  FROM split_at),
listed(lhost, lpath, lverdict, ranked) AS (VALUES {', '.join([f"('{h}', '{p}', '{v}', true)" for h, p, v in URL_RULES] + [f"('{h}', '{p}', 'block', false)" for h, p in URL_LIST])}),
fits AS (
  SELECT n, arg_max(CASE WHEN ranked THEN lhost || lpath END, (ranked, length(lhost) + length(lpath))) AS rule0,
         bool_or(ranked) AS by_rule,
         arg_max(lverdict, (ranked, length(lhost) + length(lpath))) AS verdict
  FROM parts JOIN listed ON (host = lhost OR ends_with(host, '.' || lhost)) AND starts_with(path, lpath)
  GROUP BY n)
SELECT page_id, host, path, CASE WHEN by_rule THEN rule0 END AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""

# CRC-32 half a byte at a time. The checksum's table for four bits.
_CRC_4 = [0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]
_CRC_STEP = "xor({c} >> 4, [" + ", ".join(f"{x}::BIGINT" for x in _CRC_4) + "][(xor({c}, {b}) & 15) + 1])"
_CRC_BYTE = _CRC_STEP.format(c="(" + _CRC_STEP.format(c="c", b="b") + ")", b="(b >> 4)")
OP9_SQL = f"""
WITH sized AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rn, doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) * 16 + instr('0123456789ABCDEF', h[2]) - 17)::BIGINT) AS bytes
  FROM documents),
coded AS (SELECT rn, doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: {_CRC_BYTE}), 4294967295) AS text_crc32 FROM sized),
run AS (SELECT *, sum(size) OVER (ORDER BY rn) AS e, sum(size) OVER () AS total FROM coded),
cut AS (SELECT *, least(7, ((2 * e - size) * 8) // (2 * total))::INTEGER AS shard FROM run)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY rn) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

# All pairs of documents that share a shingle, and a walk over the links.
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER_AZ.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP10_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all({_LOWER_AZ.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER_AZ.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(list_transform(range(len(w) - least(len(w), 10) + 1), lambda i: w[i + 1 : i + least(len(w), 10)])) AS g FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM grams),
wins AS (SELECT n, k, pos, array_to_string(w[pos : pos + k - 1], ' ') AS g FROM (SELECT n, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM dw, lens WHERE len(w) >= k)),
hits AS (SELECT n, item_id, pos, wins.k AS k FROM wins JOIN grams ON wins.g = grams.g AND wins.k = grams.k),
covered AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM hits) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (n) LEFT JOIN items USING (n)
"""

def _op11_sql(depth: int = 8) -> str:
    """Both trees level by level, ``depth`` of them (8^depth leaves): a level with more than one node is hashed in runs of eight."""
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) * 16 + instr('0123456789ABCDEF', h[2]) - 17)::BIGINT)), lambda c, b: {_CRC_BYTE}), 4294967295)"
    field = lambda x: f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    parts = [
        f"raw AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(_LOWER_AZ.format('text'))} END AS tampered FROM documents)",
        "doc AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM raw)",
        "a0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM doc)",
    ]

    def tree(t: str) -> None:
        for k in range(depth):
            side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {frame}), '')"
            parts.append(f"{t}s{k} AS (SELECT g, i, n, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {t}{k})")
            parts.append(
                f"{t}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ("
                f"SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {t}{k} GROUP BY g, i // 8))"
            )

    def climb(t: str, source: str, key: str) -> str:
        for k in range(depth):
            at = f"{t}w{k}"
            parts.append(
                f"{at} AS (SELECT w.* REPLACE (CASE WHEN n = 1 THEN h ELSE sha256(l || h || r) END AS h, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof) "
                f"FROM {source} w JOIN {t}s{k} s ON s.g = w.{key} AND s.i = w.{t}_i // {8**k})"
            )
            source = at
        return source

    tree("a")
    parts.append(f"top AS (SELECT a.g AS of, '' AS g, row_number() OVER (ORDER BY a.g) - 1 AS b_i, h AS subroot FROM a{depth} a)")
    parts.append("b0 AS (SELECT g, b_i AS i, subroot AS h, count(*) OVER () AS n FROM top)")
    tree("b")
    parts.append("start AS (SELECT doc_id, doc.g AS of, top.g AS one, doc.i AS a_i, b_i, leaf, subroot, coalesce(tampered, leaf) AS h, '' AS proof FROM doc JOIN top ON top.of = doc.g)")
    last = climb("b", climb("a", "start", "of"), "one")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = b.h AS verified FROM {last} w CROSS JOIN b{depth} b"


# Every term of a language priced in every group of it.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER_AZ.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, ln FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (
  SELECT x.lang, x.source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (ln + 5) // (lt + 5 * v))::BIGINT AS q
  FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_files": op2_token_files,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_media_columns": op5_media_columns,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_divergence_audit": op13_divergence_audit,
    "pipeline": pipeline.run,
}
ORACLES = {"op3_url_filter": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op8_license_scan": license_scan.oracle_sql(), "op9_sharding": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_merkle_manifest": _op11_sql(), "op13_divergence_audit": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
