"""Queries over cue tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import cues as c
from subtide.sources import adapters as a, ass



def _analyzed(s, d, compact):
    lines = ass.ass_lines(a.ass_files(s, d))
    return c.analyze_tracks(ass.ass_events(lines), ass.style_definitions(ass.ass_styles(lines)), compact)


QUERIES = {
    "p2_non_dialogue_style": lambda s, d: a.cues(s, d).select("track_id", "cue_no", c.non_dialogue_style(F.col("style")).alias("non_dialogue")),
    "p4_event_features": lambda s, d: c.event_features(a.ass_cues(s, d)),
    "g1_classify_styles": lambda s, d: c.classify_styles(a.cues(s, d)),
    "g2_style_stats": lambda s, d: c.style_stats(a.cues(s, d)),
    "g3_dialogue_spans": lambda s, d: c.dialogue_spans(a.cues(s, d)),
    "g4_activity_bins": lambda s, d: c.activity_bins(c.dialogue_spans(a.cues(s, d)), 10_000),
    "g5_density_bins": lambda s, d: c.density_bins(c.dialogue_spans(a.cues(s, d)), 30_000),
    "w1_dedup_cues": lambda s, d: c.dedup_cues(a.cues(s, d)),
    "w4_op_gap": lambda s, d: c.op_gap(a.cues(s, d)),
    "g15_coverage_check": lambda s, d: c.coverage_check(a.cues(s, d)),
    "g16_track_counters": lambda s, d: c.track_counters(a.text_lines(s, d)),
    "w15_batches": lambda s, d: c.batches(a.text_lines(s, d)),
    "s12_write_srt": lambda s, d: c.srt_text(a.cues(s, d)),
    "s16_analyze_tracks": lambda s, d: _analyzed(s, d, False),
    "s16_analyze_tracks_compact": lambda s, d: _analyzed(s, d, True),
}

PLAIN = r"regexp_replace(regexp_replace(regexp_replace(raw_text, '\{[^}]*\}', '', 'g'), '\\[Nn]', chr(10), 'g'), '\\h', ' ', 'g')"
NOT_DIALOGUE = "regexp_matches(lower(style), 'sign|song|title|op|ed|insert|inro|inen')"
FEATURES = rf"""features AS (SELECT track_id, cue_no, style, end_ms - start_ms AS duration_ms, contains(raw_text, '\pos(') AS has_pos, contains(raw_text, '\move(') AS has_move,
  contains(raw_text, '\clip(') OR contains(raw_text, '\iclip(') AS has_clip, regexp_matches(raw_text, '\\[kK]') AS has_karaoke, regexp_matches(raw_text, '\\an[1-9]') AS has_an_override,
  regexp_matches(raw_text, '\\p[1-9]') AS is_drawing, length({PLAIN})::INT AS text_length, substr({PLAIN}, 1, 80) AS preview FROM cues)"""
ASS_FEATURES = FEATURES.removesuffix("FROM cues)") + ", layer, name, effect, is_comment, margin_l, margin_r, margin_v FROM ass_ev)"


def _analysis(compact: bool) -> str:
    share = lambda x: f"(sum({x})::DOUBLE / count(*))::DECIMAL(18,3)"
    counted = {"positioned": "has_pos OR has_move", "karaoke": "has_karaoke", "drawing": "is_drawing", "clip": "has_clip", "comment": "is_comment"}
    counts = ", ".join(f"count_if({x})::BIGINT AS {n}_count" for n, x in counted.items())
    return f""", {ASS_FEATURES}, per AS (SELECT track_id, style, count(*) AS count, sum(duration_ms)::BIGINT AS total_duration_ms, sum(text_length)::BIGINT AS total_text_length, {counts},
  {share('duration_ms')} AS avg_duration_ms, {share('text_length')} AS avg_text_length, {share('(has_pos OR has_move)::INT')} AS positioned_ratio, {share('has_karaoke::INT')} AS karaoke_ratio FROM features GROUP BY ALL),
s AS (SELECT track_id, list(x ORDER BY style) AS styles FROM (SELECT track_id, style, struct_pack({', '.join(f'{c} := {c}' for c in ['style', 'count', 'total_duration_ms', 'total_text_length', *[f'{n}_count' for n in counted], 'avg_duration_ms', 'avg_text_length', 'positioned_ratio', 'karaoke_ratio'])}) AS x FROM per) GROUP BY track_id),
d AS (SELECT track_id, list(x ORDER BY style) AS style_definitions FROM (SELECT track_id, style, struct_pack({', '.join(f'{c} := {c}' for c in ['style', 'fontname'])}, fontsize := fontsize::DOUBLE, {', '.join(f'{c} := {c}' for c in ['alignment', 'bold', 'italic', 'margin_l', 'margin_r', 'margin_v'])}) AS x FROM ass_st) GROUP BY track_id),
e AS (SELECT track_id, count(*) AS event_count, list(x ORDER BY cue_no) AS events FROM (SELECT track_id, cue_no, struct_pack({', '.join(f'{c} := {c}' for c in ['cue_no', 'style', 'duration_ms', 'has_pos', 'has_move', 'has_clip', 'has_karaoke', 'has_an_override', 'is_drawing', 'text_length', 'preview', 'layer', 'name', 'effect', 'is_comment', 'margin_l', 'margin_r', 'margin_v'])}) AS x FROM features) GROUP BY track_id)
SELECT track_id, event_count, len(styles)::INT AS style_count,
  to_json(struct_pack(event_count := event_count, style_count := len(styles), styles := styles, style_definitions := style_definitions{'' if compact else ', events := events'}))::VARCHAR AS doc FROM s JOIN d USING (track_id) JOIN e USING (track_id)"""


STATS = """stats AS (SELECT track_id, style, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, sum(text_length)::BIGINT AS total_length, count_if(has_pos)::BIGINT AS n_has_pos, count_if(has_move)::BIGINT AS n_has_move,
  count_if(has_clip)::BIGINT AS n_has_clip, count_if(has_karaoke)::BIGINT AS n_has_karaoke, count_if(has_an_override)::BIGINT AS n_has_an_override, count_if(is_drawing)::BIGINT AS n_is_drawing FROM features GROUP BY track_id, style)"""
CLASSES = rf"""classes AS (SELECT *, CASE WHEN pos_share >= 0.5 THEN avg_text > 20 AND avg_ms > 1500 WHEN avg_text < 5 AND n > 50 THEN false WHEN n > 500 AND avg_ms < 500 THEN false ELSE true END AS is_dialogue
  FROM (SELECT track_id, style, count(*) AS n, sum(length(trim({PLAIN}, ' ' || chr(9) || chr(10))))::DOUBLE / count(*) AS avg_text, sum(end_ms - start_ms)::DOUBLE / count(*) AS avg_ms,
    count_if(contains(raw_text, '\pos(') OR contains(raw_text, '\move('))::DOUBLE / count(*) AS pos_share FROM cues WHERE trim(raw_text) <> '' GROUP BY track_id, style))"""
SPANS = f"""dspans AS (SELECT cues.track_id, cue_no, start_ms, end_ms, greatest(max_end, 0) AS duration_ms FROM cues
  JOIN (SELECT track_id, style FROM classes WHERE is_dialogue) USING (track_id, style) JOIN (SELECT track_id, max(end_ms) AS max_end FROM cues GROUP BY track_id) USING (track_id)
  WHERE trim(raw_text) <> '' AND NOT {NOT_DIALOGUE})"""
BINS = """SELECT DISTINCT track_id, unnest(range(f, l + 1)) AS bin FROM (SELECT track_id, greatest(0, floor(start_ms / {w}.0)::BIGINT) AS f,
  least(ceil(duration_ms / {w}.0)::BIGINT - 1, CASE WHEN end_ms > start_ms THEN floor((end_ms - 1) / {w}.0) ELSE floor(start_ms / {w}.0) END::BIGINT) AS l FROM {t}) WHERE l >= f"""
CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"

ORACLES = {
    "p2_non_dialogue_style": a.with_views("cues", f" SELECT track_id, cue_no, {NOT_DIALOGUE} AS non_dialogue FROM cues"),
    "p4_event_features": a.with_views("cues ass", f", {ASS_FEATURES} SELECT * FROM features"),
    "g1_classify_styles": a.with_views("cues", f", {CLASSES} SELECT * FROM classes"),
    "g2_style_stats": a.with_views("cues", f", {FEATURES}, {STATS} SELECT *, total_ms::DOUBLE / n AS avg_ms, total_length::DOUBLE / n AS avg_length, (n_has_pos + n_has_move)::DOUBLE / n AS pos_share, n_has_karaoke::DOUBLE / n AS karaoke_share FROM stats"),
    "g3_dialogue_spans": a.with_views("cues", f", {CLASSES}, {SPANS} SELECT * FROM dspans"),
    "g4_activity_bins": a.with_views("cues", f", {CLASSES}, {SPANS} {BINS.format(w=10000, t='dspans')}"),
    "g5_density_bins": a.with_views("cues", f""", {CLASSES}, {SPANS}, ends AS (SELECT track_id, max(ceil(duration_ms / 30000.0)::BIGINT) AS b FROM dspans GROUP BY track_id),
spine AS (SELECT track_id, unnest(range(b)) AS bin FROM ends WHERE b > 0), hits AS (SELECT track_id, least(floor(start_ms / 30000.0)::BIGINT, b - 1) AS bin, count(*) AS n FROM dspans JOIN ends USING (track_id) GROUP BY ALL)
SELECT track_id, bin, coalesce(n, 0) AS n FROM spine LEFT JOIN hits USING (track_id, bin)"""),
    "w1_dedup_cues": a.with_views("cues", """, kept AS (SELECT * REPLACE (trim(text) AS text) FROM cues WHERE length(trim(text)) >= 2),
runs AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY cue_no) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY track_id ORDER BY cue_no) = text THEN 0 ELSE 1 END AS new FROM kept))
SELECT track_id, min(cue_no) AS cue_no, arg_min(start_ms, cue_no) AS start_ms, max(end_ms) AS end_ms, arg_min(style, cue_no) AS style, text FROM runs GROUP BY track_id, run, text"""),
    "w4_op_gap": a.with_views("cues", """, g AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, cue_no) AS gap_end FROM cues)
SELECT track_id, end_ms AS gap_start, gap_end FROM g WHERE gap_end - end_ms >= 60000 AND end_ms BETWEEN 30000 AND 360000
QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY gap_end - end_ms DESC, start_ms, cue_no) = 1"""),
    "g15_coverage_check": a.with_views("cues", f""", s AS (SELECT track_id, min(start_ms) FILTER (NOT {NOT_DIALOGUE}) - min(start_ms) AS start_diff, max(end_ms) - max(end_ms) FILTER (NOT {NOT_DIALOGUE}) AS end_diff, count_if({NOT_DIALOGUE})::BIGINT AS n_other FROM cues GROUP BY track_id)
SELECT *, CASE WHEN start_diff IS NULL THEN 'empty' WHEN abs(start_diff) <= 50 AND abs(end_diff) <= 50 THEN 'within' WHEN n_other > 0 THEN 'expected' ELSE 'unexpected' END AS status FROM s"""),
    "g16_track_counters": a.with_views("lines", " SELECT track_id, count(*) AS lines, sum(length(text))::BIGINT AS chars, ceil(count(*) / 16.0)::BIGINT AS batches FROM lines GROUP BY track_id"),
    "w15_batches": a.with_views("lines", " SELECT track_id, cue_no, cue_no // 16 AS batch FROM lines"),
    "s12_write_srt": a.with_views("cues", f""", b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY cue_no) AS n FROM cues)
SELECT track_id, string_agg(n || chr(10) || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY cue_no) AS text FROM b GROUP BY track_id"""),
    "s16_analyze_tracks": a.with_views("cues ass", _analysis(False)),
    "s16_analyze_tracks_compact": a.with_views("cues ass", _analysis(True)),
}
