"""Queries that compare runs, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import runs as r
from subtide.session import fresh_path
from subtide.sources import adapters as a, documents, files as f

STATUSES = ["click", "error", "purchase", "signup", "view"]
ORDER = ["signup", "view", "click", "purchase"]


def _videos(s, d, run):
    x = r.stage_set(a.spans(s, d).where(F.col("run") == run), ["video_id"])
    return x.select(
        F.col("video_id").alias("no"), F.when(F.col("video_id") % 2 == 0, F.concat(F.lit("h"), F.col("video_id") % 100)).alias("hash"), F.lit("episode").alias("media_type"),
        F.concat(F.lit("t"), F.col("video_id") % 50).alias("title"), F.when(F.col("video_id") % 3 > 0, F.col("video_id") % 3).alias("season"), F.col("video_id").alias("episode"), "stages",
    )


def _pairs(s, d):
    return r.match_runs(_videos(s, d, "before"), _videos(s, d, "after"))


def _compared(s, d):
    x = a.spans(s, d)
    pairs = _pairs(s, d).where("NOT excluded").select(F.col("before_no").alias("before_id"), F.col("after_no").alias("after_id"))
    return r.compare_runs(x.where("run = 'before'"), x.where("run = 'after'"), pairs)


def _ranked(s, d):
    return a.spans(s, d).select("name").distinct().select("name", r.stage_rank(F.col("name"), ORDER).alias("rank")).orderBy("rank", "name")


#: Details as spans have them: numbers, text, one part only, none, and what is no JSON.
DETAILS = """CASE span_no % 5 WHEN 0 THEN '{"rss_before_mb":' || (span_no % 90) || ',"rss_after_load_mb":' || (span_no % 70 + 100) || ',"rss_after_translate_mb":' || (span_no % 40 + 200) || '}'
  WHEN 1 THEN '{"rss_before_mb":"' || (span_no % 90) || '.5","rss_after_load_mb":' || (span_no % 70 + 100) || ',"note":[1]}' WHEN 2 THEN '{"rss_after_load_mb":1}' WHEN 3 THEN 'no json' END"""


def _detailed(s, d):
    return a.spans(s, d).withColumn("_text", F.expr(DETAILS))


def _memory(s, d):
    return r.memory_deltas(_detailed(s, d).withColumn("details", F.try_parse_json("_text")))


def _reported(s, d):
    """A run's report written as one document by many tasks, and its spans read back."""
    x = _detailed(s, d).where("run = 'after'")
    entry = F.struct("span_no", "name", "duration_ms", F.col("_text").alias("details"))
    videos = x.groupBy(F.col("video_id").alias("video_no")).agg(F.sum("duration_ms").alias("total_duration_ms"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["name"].alias("name"), e["duration_ms"].alias("duration_ms"), e["details"].alias("details"))).alias("entries"))
    path = fresh_path(s, "report") + ".json"
    documents.write_report(videos.withColumn("path", F.concat(F.lit("v"), "video_no")).withColumn("hash", F.lit(None).cast("string")), path, "abc", False, {"batch": "16"}, "2024-01-01T00:00:00Z")
    spans = f.video_spans(documents.read_document(s, path, f"struct<{f.VIDEO}>").select("e.*"))
    return spans.select("path", "span_no", "name", "duration_ms", F.try_variant_get("details", "$.rss_after_load_mb", "double").alias("load_mb"))


QUERIES = {
    "g23_stage_set": lambda s, d: r.stage_set(a.spans(s, d), ["run", "video_id"]).select("run", "video_id", F.array_join("stages", ",").alias("stages")),
    "j5_match_runs": _pairs,
    "g13_compare_runs": _compared,
    "g14_compare_summary": lambda s, d: r.compare_summary(_compared(s, d)),
    "g17_run_summary": lambda s, d: r.run_summary(a.spans(s, d), STATUSES),
    "g20_throughput": lambda s, d: r.throughput(a.spans(s, d)),
    "g20_memory_deltas": _memory,
    "s15_report_round_trip": _reported,
    "w12_span_tree": lambda s, d: r.span_tree(a.spans(s, d)),
    "t4_stage_order": _ranked,
    "u3_common_spans": lambda s, d: a.spans(s, d).where("run = 'before'").select("name").intersect(a.spans(s, d).where("run = 'after'").select("name")),
}

# Hashes repeat after 100 videos, so the last video of a hash is contended for; identities are unique.
PAIRS = """vid AS (SELECT run, video_id AS no, CASE WHEN video_id % 2 = 0 THEN 'h' || (video_id % 100) END AS hash, list_sort(list_distinct(list(split_part(name, '.', 1)))) AS stages FROM spans GROUP BY run, video_id),
b AS (SELECT * FROM vid WHERE run = 'before'), f AS (SELECT * FROM vid WHERE run = 'after'),
hc AS (SELECT b.no, arg_max(f.no, f.no) AS h_no FROM b JOIN f USING (hash) GROUP BY b.no),
ord AS (SELECT b.no, h_no, i.no AS i_no, row_number() OVER (ORDER BY b.no) AS rn FROM b LEFT JOIN hc USING (no) LEFT JOIN f i ON i.no = b.no),
ok AS (SELECT ord.*, b.stages = hf.stages AS h_ok, b.stages = jf.stages AS i_ok FROM ord JOIN b USING (no) LEFT JOIN f hf ON hf.no = h_no LEFT JOIN f jf ON jf.no = i_no),
greedy AS (WITH RECURSIVE g(rn, used, before_no, after_no, how, excluded) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, false
  UNION ALL
  SELECT o.rn, CASE WHEN c IS NOT NULL AND fit THEN list_append(used, c) ELSE used END, o.no, c, w, c IS NOT NULL AND NOT fit
  FROM g JOIN ok o ON o.rn = g.rn + 1,
  LATERAL (SELECT CASE WHEN h_no IS NOT NULL AND NOT list_contains(used, h_no) THEN h_no WHEN i_no IS NOT NULL AND NOT list_contains(used, i_no) THEN i_no END AS c,
    CASE WHEN h_no IS NOT NULL AND NOT list_contains(used, h_no) THEN 'hash' WHEN i_no IS NOT NULL AND NOT list_contains(used, i_no) THEN 'identity' END AS w,
    CASE WHEN h_no IS NOT NULL AND NOT list_contains(used, h_no) THEN h_ok ELSE i_ok END AS fit) x)
  SELECT before_no, after_no, how, excluded FROM g WHERE after_no IS NOT NULL)"""
COMPARED = """s1 AS (SELECT run, video_id, name, arg_max(duration_ms, span_no) AS ms FROM spans GROUP BY ALL),
cmp AS (SELECT name, avg(x.ms) AS before_ms, avg(y.ms) AS after_ms, count(*) AS n FROM greedy JOIN s1 x ON x.run = 'before' AND x.video_id = before_no JOIN s1 y USING (name) WHERE y.run = 'after' AND y.video_id = after_no AND NOT excluded GROUP BY name),
d AS (SELECT *, after_ms - before_ms AS delta_ms, CASE WHEN before_ms <> 0 THEN (after_ms - before_ms) / before_ms * 100 ELSE 0 END AS delta_pct FROM cmp)"""
S = "spans"

ORACLES = {
    "g23_stage_set": a.with_views(S, " SELECT run, video_id, array_to_string(list_sort(list_distinct(list(split_part(name, '.', 1)))), ',') AS stages FROM spans GROUP BY run, video_id"),
    "j5_match_runs": a.with_views(S, f", {PAIRS} SELECT * FROM greedy"),
    "g13_compare_runs": a.with_views(S, f", {PAIRS}, {COMPARED} SELECT * FROM d"),
    "g14_compare_summary": a.with_views(S, f""", {PAIRS}, {COMPARED}, t AS (SELECT sum(before_ms) AS before_ms, sum(after_ms) AS after_ms, arg_min(name, delta_pct) AS w, min(delta_pct) AS p, string_agg(printf('%s %.1f -> %.1f', name, before_ms, after_ms), chr(10) ORDER BY printf('%s %.1f -> %.1f', name, before_ms, after_ms)) AS "table" FROM d)
SELECT before_ms, after_ms, (after_ms - before_ms) / before_ms * 100 AS overall_pct, CASE WHEN after_ms < before_ms THEN 'faster' WHEN after_ms > before_ms THEN 'slower' ELSE 'same' END AS direction, CASE WHEN p < 0 THEN w END AS biggest_win, "table" FROM t"""),
    "g17_run_summary": a.with_views(S, " SELECT run, " + ", ".join(f"count_if(status = '{x}')::BIGINT AS {x}" for x in STATUSES) + " FROM spans GROUP BY run"),
    "g20_throughput": a.with_views(S, " SELECT name, " + ", ".join(f"CASE WHEN count(*) FILTER (run = '{x}') = 0 THEN NULL WHEN sum(duration_ms) FILTER (run = '{x}') > 0 THEN count(*) FILTER (run = '{x}') / (sum(duration_ms) FILTER (run = '{x}') / 1000) ELSE 0 END AS {x}" for x in ("before", "after")) + " FROM spans GROUP BY name"),
    "g20_memory_deltas": a.with_views(S, f""", x AS (SELECT *, {DETAILS} AS t FROM spans), y AS (SELECT *, CASE WHEN json_valid(t) THEN t END AS j FROM x),
z AS (SELECT run, name, try_cast(j ->> 'rss_after_load_mb' AS DOUBLE) - try_cast(j ->> 'rss_before_mb' AS DOUBLE) AS l, try_cast(j ->> 'rss_after_translate_mb' AS DOUBLE) - try_cast(j ->> 'rss_after_load_mb' AS DOUBLE) AS m FROM y)
SELECT run, name, count(coalesce(l, m)) AS n, avg(l) AS load_mb, avg(m) AS translate_mb FROM z GROUP BY run, name"""),
    "s15_report_round_trip": a.with_views(S, f""", x AS (SELECT *, {DETAILS} AS t FROM spans WHERE run = 'after')
SELECT 'v' || video_id AS path, (row_number() OVER (PARTITION BY video_id ORDER BY span_no) - 1)::INT AS span_no, name, duration_ms, CASE WHEN json_valid(t) THEN (t ->> 'rss_after_load_mb')::DOUBLE END AS load_mb FROM x"""),
    "w12_span_tree": a.with_views(S, """, o AS (SELECT run, video_id, name, sum(duration_ms) AS total_ms, CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') END AS parent FROM spans GROUP BY ALL)
SELECT run, video_id, name, parent, total_ms, total_ms - coalesce((SELECT sum(k.total_ms) FROM o k WHERE k.run = o.run AND k.video_id = o.video_id AND k.parent = o.name), 0) AS self_ms FROM o"""),
    "t4_stage_order": a.with_views(S, f" SELECT DISTINCT name, coalesce(nullif(list_position({ORDER!r}, split_part(name, '.', 1)), 0), {len(ORDER) + 1})::BIGINT AS rank FROM spans"),
    "u3_common_spans": a.with_views(S, " SELECT name FROM spans WHERE run = 'before' INTERSECT SELECT name FROM spans WHERE run = 'after'"),
}
