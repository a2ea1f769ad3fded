"""Queries over files' texts, streams and translation, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import cues as c, translate as t
from subtide.session import fresh_path, table
from subtide.plans.cue_queries import PLAIN
from subtide.sources import adapters as a, ass, files as f, responses
from subtide.streaming import spans as x


def _shifted(s, d):
    return a.cues(s, d).select("track_id", "cue_no", "start_ms", "end_ms", "text")


def _written(s, d):
    lines = ass.ass_lines(a.ass_files(s, d))
    return ass.write_ass(lines, ass.ass_events(lines).where("NOT is_comment"), F.upper)


def _lines(s, d):
    return a.text_lines(s, d).withColumn("text", F.when(F.col("cue_no") % 4 == 3, "").otherwise(F.col("text")))


def _protected(s, d):
    p = a.text_lines(s, d).withColumn("p", t.protect(["The", "And"])("text"))
    return p.select("track_id", "cue_no", F.col("p.text").alias("protected"), (t.restore(F.col("p.text"), F.col("p.tags")) == F.col("text")).alias("same"))


def _bodies(s, d, **kinds):
    """(media_id, a body of each kind): search responses of one customer each, its orders' items in order; a kind is (item, what is before the items, what is after them)."""
    o = table(s, d, "orders").withColumn("k", F.col("o_orderkey"))
    items = F.sort_array(F.collect_list(F.struct("k", *[F.expr(item).alias(name) for name, (item, _, _) in kinds.items()])))
    joined = lambda name, first, last: F.concat(F.lit(first), F.array_join(f"items.{name}", "," if first[0] == "{" else ""), F.lit(last)).alias(name)
    return o.groupBy(F.col("o_custkey").alias("media_id")).agg(items.alias("items")).select("media_id", *[joined(name, *rest) for name, (_, *rest) in kinds.items()])


JSON_ITEM = """'{"id":"' || k || '","attributes":{"language":"' || element_at(array('en', 'pl', 'de', 'pl'), CAST(k % 4 AS INT) + 1) || '","release":"' || o_orderpriority || '","moviehash_match":' || (k % 7 = 0)
  || ',"files":[' || CASE WHEN k % 5 = 0 THEN '' ELSE '{"file_id":' || k || ',"file_name":"' || element_at(array('a.ASS', 'noext', 'a.b.srt'), CAST(k % 3 AS INT) + 1) || '"}' END || ']}}'"""
XML_ITEM = """'<subtitle><id>' || k || '</id>' || CASE WHEN k % 3 = 0 THEN '' ELSE '<release>' || o_orderpriority || ' &amp; R</release>' END || '<language>' || element_at(array('en', 'pl', 'de', 'pol'), CAST(k % 4 AS INT) + 1) || '</language></subtitle>'"""
HTML_ITEM = """'<TABLE class="Napisy"><tr><td width="45%"><b>' || o_orderpriority || '</b> &amp; x</td><td width=20%>' || element_at(array('SSA', 'MicroDVD', 'Advanced SSA', 'srt'), CAST(k % 4 AS INT) + 1)
  || '</td></tr><tr><td><table><tr><td width="45%">no title</td></tr></table><input type="hidden" name="id" value="' || k || '">' || CASE WHEN k % 5 = 0 THEN '' ELSE '<input type=hidden name=sh value=s' || k || '>' END || '</td></tr></TABLE>'"""


JSON = (JSON_ITEM, '{"data":[', "]}")
XML = (XML_ITEM, "<results><page>1</page>", "</results>")
HTML = (HTML_ITEM, "<html><table><tr><td>menu</td></tr></table>", "</html>")
RAW_FILENAME = "CASE WHEN media_id % 3 > 0 THEN '1-urgent.release' END"
XML_BODY = "CASE WHEN media_id % 11 = 0 THEN '<x>' || {0} ELSE {0} END"


def _json(s, d):
    return _bodies(s, d, body=JSON).withColumn("raw_filename", F.expr(RAW_FILENAME))


def _xml(s, d):
    return _bodies(s, d, body=XML).select("media_id", (F.col("media_id") % 4 == 0).alias("hash_match"), F.expr(XML_BODY.format("body")).alias("body"))


def _responses_of(s, d):
    """The saved responses of all three services, made in one pass over the orders, written and read through the data source."""
    none = F.lit(None)
    of = lambda name, raw, hashed, body: F.struct(F.lit(name).alias("source"), raw.cast("string").alias("raw_filename"), hashed.cast("boolean").alias("hash_match"), F.expr(body).alias("body"))
    three = F.array(
        of("opensubtitles", F.expr(RAW_FILENAME), none, "json"), of("podnapisi", none, F.col("media_id") % 4 == 0, XML_BODY.format("xml")), of("animesub", none, none, "html"),
    )
    path = fresh_path(s, "responses")
    responses.save_responses(_bodies(s, d, json=JSON, xml=XML, html=HTML).select("media_id", F.inline(three)), path)
    return responses.candidates_of(responses.read_responses(s, path))


def _upper(texts):
    return [x.upper() for x in texts]


def _messages(s, d):
    kind = F.create_map(*[F.lit(v) for v in ("signup", "start", "view", "span", "click", "span", "purchase", "update", "error", "end")])
    return x.event_stream(s, d).select(F.col("user_id").alias("video_id"), F.col("event_id").alias("no"), F.element_at(kind, F.col("event_type")).alias("kind"), F.col("value"), "ts")


def _cue_stream(s, d):
    e = x.event_stream(s, d)
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("cue_no"), start.alias("start_ms"), (start + 500 + F.col("event_id") * 37 % 3000).alias("end_ms"), F.col("event_type").alias("style"), F.col("event_type").alias("text"), "ts")


def _span_windows(s, d):
    got = x.run_available(x.span_stream(x.event_stream(s, d)), ["start", "name"])
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "name", "n", "total_ms")


def _status_windows(s, d):
    got = x.run_available(x.status_counts(x.event_stream(s, d)), ["start"], "append")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "completed", "failed", "skipped", "running")


QUERIES = {
    "s2_parse_srt": lambda s, d: f.parse_srt(c.srt_text(_shifted(s, d))),
    "s3_parse_ass": lambda s, d: a.ass_cues(s, d),
    "s3_ass_styles": lambda s, d: ass.style_definitions(ass.ass_styles(ass.ass_lines(a.ass_files(s, d)))),
    "s13_write_ass": _written,
    "s13_ass_round_trip": lambda s, d: ass.ass_text_of(ass.ass_lines(a.ass_files(s, d))),
    "s4_srt_text_lines": lambda s, d: f.srt_text_lines(_lines(s, d)),
    "s5_normalize_encoding": lambda s, d: table(s, d, "documents").select("doc_id", f.normalize_encoding(F.col("text").cast("binary")).cast("string").alias("text")),
    "s6_fingerprints": lambda s, d: f.fingerprint_blobs(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))),
    "s8_candidates_from_json": lambda s, d: f.candidates_from_json(_json(s, d)),
    "s9_candidates_from_xml": lambda s, d: f.candidates_from_xml(_xml(s, d)),
    "s10_candidates_from_html": lambda s, d: f.candidates_from_html(_bodies(s, d, body=HTML)),
    "p11_protect_placeholders": _protected,
    "f3_translate_lines": lambda s, d: t.translate_lines(a.text_lines(s, d), _upper, ["The"]).select("track_id", "cue_no", "translation"),
    "f1_saved_responses": _responses_of,
    "f3_translate_units": lambda s, d: t.translate_units(a.text_lines(s, d), _upper, ["The"]),
    "x1_span_stream": _span_windows,
    "x2_video_reports": lambda s, d: x.run_available(x.video_reports(_messages(s, d)), ["video_id", "start_no"]),
    "x3_progress_table": lambda s, d: x.run_available(x.progress_table(x.event_stream(s, d)), ["file_id"]),
    "x3_status_counts": _status_windows,
    "x4_dedup_stream": lambda s, d: x.run_available(x.dedup_stream(_cue_stream(s, d)), ["track_id", "cue_no"]),
}

ASS_CLOCK = "printf('%d:%02d:%02d.%02d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, ({0} // 10) % 100)"
ASS_FILE = f""", st AS (SELECT track_id, string_agg('Style: ' || style || ',' || fontname || ',' || fontsize || ',&H00FFFFFF,' || CASE WHEN bold THEN -1 ELSE 0 END || ',0,' || alignment || ',' || margin_l || ',10,' || margin_v, chr(10) ORDER BY style) AS l FROM ass_st GROUP BY track_id),
ev AS (SELECT track_id, string_agg(CASE WHEN is_comment THEN 'Comment: ' ELSE 'Dialogue: ' END || layer || ',' || {ASS_CLOCK.format('start_ms')} || ',' || {ASS_CLOCK.format('end_ms')} || ',' || style || ',' || name || ',' || margin_l || ',0,' || margin_v || ',' || effect || ',' || raw_text, chr(10) ORDER BY cue_no) AS l FROM ass_ev GROUP BY track_id),
head AS (SELECT track_id, '[Script Info]' || chr(10) || 'Title: ' || track_id || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: 1920' || chr(10) || chr(10) || '[V4+ Styles]' || chr(10) || '{a.STYLE_FORMAT}' || chr(10) || l || chr(10) || chr(10) || '[Events]' || chr(10) || '{ass.EVENT_FORMAT}' || chr(10) AS head FROM st)"""
NUMBERED = "row_number() OVER (PARTITION BY track_id ORDER BY cue_no)"
ORACLES = {
    "s2_parse_srt": a.with_views("cues", f" SELECT track_id, {NUMBERED} AS cue_no, start_ms, end_ms, text FROM cues"),
    "s3_parse_ass": a.with_views("cues ass", f" SELECT *, {PLAIN} AS text FROM ass_ev"),
    "s3_ass_styles": a.with_views("cues ass", " SELECT * REPLACE (fontsize::DOUBLE AS fontsize) FROM ass_st"),
    "s13_write_ass": a.with_views("cues ass", ASS_FILE + f""", pick AS (SELECT track_id, min(style) AS st FROM ass_st GROUP BY track_id),
out AS (SELECT track_id, string_agg('Dialogue: 0,' || {ASS_CLOCK.format('start_ms')} || ',' || {ASS_CLOCK.format('end_ms')} || ',' || st || ',,0,0,0,,' || replace(upper({PLAIN}), chr(10), '\\N'), chr(10) ORDER BY cue_no) AS l FROM ass_ev JOIN pick USING (track_id) WHERE NOT is_comment GROUP BY track_id)
SELECT track_id, head || l || chr(10) AS text FROM head JOIN out USING (track_id)"""),
    "s13_ass_round_trip": a.with_views("cues ass", ASS_FILE + " SELECT track_id, head || ev.l || chr(10) AS text FROM head JOIN ev USING (track_id)"),
    "s4_srt_text_lines": a.with_views("lines", r""", e AS (SELECT track_id, cue_no, CASE WHEN cue_no % 4 = 3 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS t FROM lines),
b AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY cue_no)::BIGINT AS block FROM e) SELECT track_id, block, string_agg(t, ' ' ORDER BY cue_no) AS text FROM b WHERE t <> '' AND NOT contains(t, '-->') AND NOT regexp_matches(t, '^\d+$') GROUP BY track_id, block"""),
    "s8_candidates_from_json": """SELECT o_custkey AS media_id, 'opensubtitles' AS source, o_orderkey::VARCHAR AS subtitle_id, CASE o_orderkey % 4 WHEN 0 THEN 'eng' ELSE 'pol' END AS language, o_orderpriority AS release_name,
  ['ASS', 'srt', 'srt'][o_orderkey % 3 + 1] AS format, CASE WHEN o_orderkey % 7 = 0 THEN 1.0 WHEN o_custkey % 3 = 0 THEN 0.7 WHEN o_orderpriority = '1-URGENT' THEN 0.6::DOUBLE + 0.3::DOUBLE * (2.0::DOUBLE / 3) ELSE 0.6 END::DOUBLE AS score,
  o_orderkey % 7 = 0 AS hash_match FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 2""",
    "s9_candidates_from_xml": """SELECT o_custkey AS media_id, 'podnapisi' AS source, o_orderkey::VARCHAR AS subtitle_id, CASE o_orderkey % 4 WHEN 0 THEN 'eng' ELSE 'pol' END AS language,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || ' & R' END AS release_name, 'srt' AS format, CASE WHEN o_custkey % 4 = 0 THEN 0.9 ELSE 0.65 END::DOUBLE AS score, o_custkey % 4 = 0 AS hash_match
  FROM orders WHERE o_orderkey % 4 <> 2 AND o_custkey % 11 <> 0""",
    "s10_candidates_from_html": """SELECT o_custkey AS media_id, 'animesub' AS source, o_orderkey::VARCHAR AS subtitle_id, 's' || o_orderkey AS sh, o_orderpriority || ' & x' AS release_name,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'ass' ELSE 'srt' END AS format FROM orders WHERE o_orderkey % 5 <> 0""",
    "f1_saved_responses": """FROM_JSON UNION ALL FROM_XML UNION ALL
SELECT media_id, source, subtitle_id, 'pol' AS language, release_name, format, 0.6::DOUBLE AS score, false AS hash_match FROM (FROM_HTML)""",
    "s5_normalize_encoding": "SELECT doc_id, text FROM documents",
    "s6_fingerprints": """WITH b AS (SELECT doc_id AS id, encode(text) AS content, octet_length(encode(text)) AS n FROM documents),
w AS (SELECT id, h, unnest(range(0, len(h), 16)) AS p FROM (SELECT id, unnest([hex(content[1:65536]), hex(content[greatest(1, n - 65535):])]) AS h FROM b WHERE n > 0)),
r AS (SELECT id, rpad(substr(h, p + 1, 16), 16, '0') AS c FROM w),
v AS (SELECT id, list_sum(list_transform(range(1, 9), lambda i: ((instr('0123456789ABCDEF', c[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', c[2 * i]) - 1)::HUGEINT * (1::HUGEINT << (8 * (i - 1))::INT))) AS word FROM r),
s AS (SELECT id, sum(word)::HUGEINT AS total FROM v GROUP BY id)
SELECT b.id, CASE WHEN n > 0 THEN lower(lpad(to_hex(((total + n) % 18446744073709551616)::UBIGINT), 16, '0')) END AS oshash, md5(content[1:10485760]) AS md5 FROM b LEFT JOIN s USING (id)""",
    "x1_span_stream": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS name, count(*) AS n, sum(value * 10) AS total_ms FROM events GROUP BY ALL",
    "x2_video_reports": """WITH m AS (SELECT user_id AS video_id, event_id AS no, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'span' WHEN 'click' THEN 'span' WHEN 'purchase' THEN 'update' ELSE 'end' END AS kind, value FROM events),
s AS (SELECT *, max(CASE WHEN kind = 'start' THEN no END) OVER (PARTITION BY video_id ORDER BY no) AS start_no FROM m),
e AS (SELECT *, min(CASE WHEN kind = 'end' THEN no END) OVER (PARTITION BY video_id, start_no) AS end_no FROM s WHERE start_no IS NOT NULL)
SELECT video_id, start_no, count_if(kind = 'span')::BIGINT AS n_spans, coalesce(sum(value) FILTER (kind = 'span'), 0) AS total_ms, count_if(kind = 'update')::BIGINT AS n_updates FROM e WHERE no < end_no GROUP BY video_id, start_no""",
    "x3_progress_table": """SELECT user_id AS file_id, arg_max(event_type, (ts, event_id)) AS stage, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'running' END AS status,
  count_if(event_type <> 'error')::BIGINT AS done, count(*) AS total, sum(value) AS units, CASE WHEN max(ts) > min(ts) THEN count_if(event_type <> 'error') * 1e6 / date_diff('microsecond', min(ts), max(ts)) ELSE 0 END::DOUBLE AS rate FROM events GROUP BY user_id""",
    "x3_status_counts": """WITH f AS (SELECT date_trunc('day', ts) AS d, user_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS day, count_if(stage = 'purchase')::BIGINT AS completed, count_if(stage = 'error')::BIGINT AS failed, count_if(stage = 'signup')::BIGINT AS skipped, count_if(stage NOT IN ('purchase', 'error', 'signup'))::BIGINT AS running
FROM f WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY d""",
    "x4_dedup_stream": a.with_views("cues", """, runs AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY cue_no) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY track_id ORDER BY cue_no) = text THEN 0 ELSE 1 END AS new FROM cues))
SELECT track_id, min(cue_no) AS cue_no, arg_min(start_ms, cue_no) AS start_ms, max(end_ms) AS end_ms, arg_min(style, cue_no) AS style, text FROM runs GROUP BY track_id, run, text"""),
}
ORACLES["f1_saved_responses"] = ORACLES["f1_saved_responses"].replace("FROM_JSON", ORACLES["s8_candidates_from_json"]).replace("FROM_XML", ORACLES["s9_candidates_from_xml"]).replace("FROM_HTML", ORACLES["s10_candidates_from_html"])
