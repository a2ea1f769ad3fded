"""The query over the whole fetch chain, from saved search responses on, and its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import cues as c, fetch, select
from subtide.session import written
from subtide.plans import edge_queries as e, match_queries as m, select_queries as q
from subtide.sources import adapters as a, files as f

COLUMNS = ["media_id", "source", "subtitle_id", "language", "score", "hash_match"]


def _found(s, d):
    """Candidates of the three services' responses, those of the hash search first."""
    html = e.QUERIES["s10_candidates_from_html"](s, d).withColumns({"language": F.lit("pol"), "hash_match": F.lit(False)})
    html = html.withColumn("score", select.provider_score(F.col("source"), F.col("hash_match"), F.lit(None).cast("double")))
    found = f.candidates_from_json(e._json(s, d)).select(*COLUMNS).union(f.candidates_from_xml(e._xml(s, d)).select(*COLUMNS)).union(html.select(*COLUMNS))
    numbered = found.withColumn("result_no", F.col("subtitle_id"))
    return select.merge_candidates(numbered.where("hash_match"), numbered.where("NOT hash_match")).select(*COLUMNS)


def _files(s, d, found):
    """A file for each candidate of a media that has a candidate track: that track, later by up to 1.8 seconds."""
    found = found.select(*fetch.KEY, (F.col("subtitle_id").cast("long") % 4 * 600).alias("late"))
    variants = found.select("media_id", "late").distinct()  # a text is made once for all files that have it
    x = variants.join(a.candidate_cues(s, d).withColumnRenamed("pair_id", "media_id"), "media_id")
    x = x.withColumns({"start_ms": F.greatest(F.lit(0), F.col("start_ms") + F.col("late")), "end_ms": F.greatest(F.lit(0), F.col("end_ms") + F.col("late"))})
    texts = c.srt_text(x.select(F.struct("media_id", "late").alias("track_id"), "cue_no", "start_ms", "end_ms", "text")).select("track_id.*", "text")
    return found.join(texts, ["media_id", "late"]).select(*fetch.KEY, F.col("text").cast("binary").alias("content"))


def _fetched(s, d):
    found = written(_found(s, d), "found")
    refs = a.references(s, d).select(F.col("pair_id").alias("media_id"), "cue_no", "start_ms", "end_ms")
    english = select.english_track(a.tracks(s, d)).select("media_id")  # media without an English track have no reference
    return fetch.fetch_subtitles(found, _files(s, d, found), refs.join(english, "media_id", "left_semi"))


QUERIES = {"l4_fetch_pipeline": _fetched}

NAMED = "SELECT media_id, source, subtitle_id, language, score, hash_match FROM"
# A media's files are one track, late by one of four amounts, so the oracle plans each of these once.
ORACLES = {
    "l4_fetch_pipeline": f"""WITH found AS (SELECT *, media_id || ':' || source || ':' || subtitle_id AS pair_id FROM ({NAMED} ({e.ORACLES['s8_candidates_from_json']}) UNION ALL {NAMED} ({e.ORACLES['s9_candidates_from_xml']})
  UNION ALL SELECT media_id, source, subtitle_id, 'pol', 0.6, false FROM ({e.ORACLES['s10_candidates_from_html']}))),
base AS ({a.with_views('cues cands', ' SELECT * FROM cands')}), plain AS ({a.with_views('cues refs', f" SELECT * FROM refs WHERE pair_id IN (SELECT media_id FROM ({q.ORACLES['w13_english_track']}))")}),
dl AS MATERIALIZED (SELECT f.pair_id, cue_no, greatest(0, start_ms + subtitle_id::BIGINT % 4 * 600) AS start_ms, greatest(0, end_ms + subtitle_id::BIGINT % 4 * 600) AS end_ms, text FROM found f JOIN base ON base.pair_id = f.media_id),
allrefs AS MATERIALIZED (SELECT f.pair_id, cue_no, start_ms, end_ms FROM found f JOIN plain ON plain.pair_id = f.media_id),
s AS MATERIALIZED (WITH refs AS (SELECT * FROM allrefs), {m.NEAR.format(c='dl')}, {m.SCORED.format(n='s', t='near')} SELECT * FROM s),
rated AS (SELECT f.*, CASE WHEN media_id IN (SELECT pair_id FROM plain) THEN s.score END AS match_score FROM found f JOIN s USING (pair_id)),
kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, language ORDER BY match_score DESC NULLS LAST, score DESC, hash_match DESC, source, subtitle_id)::INT AS place
  FROM rated WHERE match_score >= 0.5 OR media_id NOT IN (SELECT pair_id FROM plain)) WHERE place = 1 OR match_score >= 0.8),
variants AS MATERIALIZED (SELECT DISTINCT media_id * 4 + subtitle_id::BIGINT % 4 AS v, media_id, subtitle_id::BIGINT % 4 AS k FROM kept WHERE language = 'pol' AND match_score IS NOT NULL),
by_variant AS MATERIALIZED (WITH refs AS MATERIALIZED (SELECT v AS pair_id, cue_no, start_ms, end_ms FROM variants JOIN plain ON plain.pair_id = media_id),
  cands AS MATERIALIZED (SELECT v AS pair_id, cue_no, greatest(0, start_ms + k * 600) AS start_ms, greatest(0, end_ms + k * 600) AS end_ms, text FROM variants JOIN base ON base.pair_id = media_id), {m.PLAN} SELECT * FROM plan),
plan AS MATERIALIZED (SELECT kept.pair_id, boundary_ms, pre_ms, post_ms FROM kept JOIN by_variant b ON b.pair_id = media_id * 4 + subtitle_id::BIGINT % 4 WHERE language = 'pol' AND match_score IS NOT NULL),
shifted AS (SELECT pair_id, start_ms + d AS start_ms, end_ms + d AS end_ms FROM (
  SELECT dl.*, coalesce(CASE WHEN start_ms < boundary_ms THEN pre_ms ELSE post_ms END, 0) AS d FROM dl JOIN kept USING (pair_id) LEFT JOIN plan USING (pair_id)))
SELECT media_id, language, place, source, subtitle_id, match_score, boundary_ms, pre_ms, post_ms, n_cues, first_ms, last_ms, sum_ms FROM kept LEFT JOIN plan USING (pair_id)
LEFT JOIN (SELECT pair_id, count(*) AS n_cues, min(start_ms) AS first_ms, max(end_ms) AS last_ms, sum(start_ms)::BIGINT AS sum_ms FROM shifted GROUP BY pair_id) x USING (pair_id)""",
}
