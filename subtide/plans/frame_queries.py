"""Queries over frames and recognised text, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import frames as f
from subtide.sources import adapters as a

CHANGE, VARIANCE = 28.0, 621.0


def _boxes(s, d):
    x = a.frames(s, d).withColumns({"_full": f.map_boxes(F.col("boxes"), 0.4), "_region": f.crop_region(F.col("boxes"), 640, 360)})
    x = x.withColumns({"_local": f.remap_boxes(F.col("boxes"), F.col("_region"), 640, 360), "_mask": f.mask_rect(F.col("boxes")[0], 640, 360)})
    return x.select("media_id", "frame_no", F.col("_full")[0]["y"].alias("full_y"), "_region.y1", "_region.y2", F.col("_local")[0]["y"].alias("local_y"), *[F.col(f"_mask.{c}").alias(f"mask_{c}") for c in ("x1", "y1", "x2", "y2")])


QUERIES = {
    "w2_ocr_lines_burned_in": lambda s, d: f.ocr_lines_burned_in(a.ocr_frames(s, d)),
    "w3_ocr_lines_pgs": lambda s, d: f.ocr_lines_pgs(a.ocr_frames(s, d)),
    "g22_frame_stats": lambda s, d: f.frame_stats(a.frames(s, d)),
    "w5_transition_frames": lambda s, d: f.transition_frames(a.frames(s, d), CHANGE, VARIANCE),
    "w6_transitions": lambda s, d: f.transitions(a.frames(s, d), CHANGE, VARIANCE),
    "j13_last_clean_frame": lambda s, d: f.last_clean_frame(a.frames(s, d)),
    "j14_subtitle_frames": lambda s, d: f.subtitle_frames(a.frames(s, d), 24.0).select("media_id", "frame", "from_no"),
    "g21_scene_cut": lambda s, d: f.scene_cut(a.frames(s, d)),
    "g18_burned_in_probe": lambda s, d: f.burned_in_probe(a.ocr_frames(s, d).withColumn("frame_hash", F.col("frame_no") * 7919 % 10007)),
    "p20_boxes": _boxes,
}

RUNS = """runs AS (SELECT *, lead(ts_ms) OVER o AS nxt, lead(text) OVER o AS nxt_text FROM (SELECT *, max(ts_ms) OVER (PARTITION BY media_id) AS last_ts, lag(text) OVER (PARTITION BY media_id ORDER BY ts_ms, frame_no) IS DISTINCT FROM text AS fresh FROM {t})
  WHERE fresh WINDOW o AS (PARTITION BY media_id ORDER BY ts_ms, frame_no))"""
STATS = """stats AS (SELECT media_id, frame_no, ts_ms, list_sum(list_transform(pixels, lambda x: x::BIGINT * x)) / len(pixels)::DOUBLE - (list_sum(pixels) / len(pixels)::DOUBLE) * (list_sum(pixels) / len(pixels)::DOUBLE) AS variance,
  list_sum(list_transform(list_zip(pixels, prev), lambda z: abs(z[1] - z[2]))) / len(pixels)::DOUBLE AS diff FROM (SELECT *, lag(pixels) OVER (PARTITION BY media_id ORDER BY frame_no) AS prev FROM frames))"""

ORACLES = {
    "w2_ocr_lines_burned_in": a.with_views("ocr", f", shown AS (SELECT * FROM ocr WHERE text <> ''), {RUNS.format(t='shown')} SELECT media_id, ts_ms AS start_ms, coalesce(nxt, last_ts + 1000) AS end_ms, text FROM runs WHERE length(text) > 1"),
    "w3_ocr_lines_pgs": a.with_views("ocr", f", {RUNS.format(t='ocr')} SELECT media_id, ts_ms AS start_ms, coalesce(nxt, last_ts + 3000) AS end_ms, text FROM runs WHERE text <> '' AND NOT (ts_ms <= 0 AND coalesce(nxt_text, '') <> '')"),
    "g22_frame_stats": a.with_views("frames", f", {STATS} SELECT * FROM stats"),
    "w5_transition_frames": a.with_views("frames", f", {STATS} SELECT media_id, frame_no, ts_ms FROM (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM stats) WHERE n < 2 OR (variance > {VARIANCE} AND (diff IS NULL OR diff > {CHANGE}))"),
    "w6_transitions": a.with_views("frames", f""", {STATS}, m AS (SELECT *, variance > {VARIANCE} AS has, CASE WHEN diff IS NULL OR diff > {CHANGE} THEN variance > {VARIANCE} END AS state FROM stats),
b AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT media_id, frame_no, ts_ms, CASE WHEN has THEN 'appeared' ELSE 'disappeared' END AS kind FROM b WHERE diff > {CHANGE} AND (has OR before)"""),
    "j13_last_clean_frame": a.with_views("frames", " SELECT media_id, frame_no, (SELECT max(g.frame_no) FROM frames g WHERE g.media_id = f.media_id AND g.frame_no < f.frame_no AND NOT g.has_subtitle) AS clean_no FROM frames f WHERE has_subtitle"),
    "j14_subtitle_frames": a.with_views("frames", " SELECT media_id, frame, max(frame_no) AS from_no FROM (SELECT media_id, frame_no, unnest(range(floor(ts_ms * 24.0 / 1000)::BIGINT, floor((ts_ms + 1000) * 24.0 / 1000)::BIGINT)) AS frame FROM frames WHERE has_subtitle) GROUP BY ALL"),
    "g21_scene_cut": a.with_views("frames", """, h AS (SELECT media_id, frame_no, least(v * 64 // 256, 63) AS bin, count(*) AS n FROM (SELECT media_id, frame_no, unnest(pixels[1:greatest(1, len(pixels) // 2)]) AS v FROM frames) GROUP BY ALL),
s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY media_id, frame_no) AS p FROM h), pairs AS (SELECT DISTINCT x.media_id, x.frame_no FROM s x JOIN s y ON x.media_id = y.media_id AND y.frame_no = x.frame_no - 1)
SELECT media_id, frame_no, coalesce(sim, 0) AS similarity, coalesce(sim, 0) < 0.4 AS is_cut FROM pairs LEFT JOIN (SELECT x.media_id, x.frame_no, sum(least(x.p, y.p)) AS sim FROM s x JOIN s y ON x.media_id = y.media_id AND y.frame_no = x.frame_no - 1 AND x.bin = y.bin GROUP BY ALL) USING (media_id, frame_no)"""),
    "g18_burned_in_probe": a.with_views("ocr", """, m AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ts_ms, frame_no) AS r, count(*) OVER (PARTITION BY media_id) AS n FROM ocr),
s AS (SELECT * FROM m WHERE r > n * 0.05 AND r <= n * 0.95 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY frame_no * 7919 % 10007, frame_no) <= 100)
SELECT media_id, count_if(length(text) >= 8)::BIGINT AS hits, count(*) AS sampled, count_if(length(text) >= 8) >= greatest(1, floor(count(*) * 0.08)) AS burned_in FROM s GROUP BY media_id"""),
    "p20_boxes": a.with_views("frames", """, r AS (SELECT *, greatest(0, floor(y * 360)::BIGINT - 40) AS y1, least(360, floor((y + height) * 360)::BIGINT + 40) AS y2 FROM frames)
SELECT media_id, frame_no, (1 - 0.4::DOUBLE) + y * 0.4::DOUBLE AS full_y, y1, y2, (y * 360 - y1) / (y2 - y1) AS local_y, greatest(0, floor(x * 640)::BIGINT - 20) AS mask_x1, greatest(0, floor(y * 360)::BIGINT - 20) AS mask_y1,
  least(640, floor((x + width) * 640)::BIGINT + 20) AS mask_x2, least(360, floor((y + height) * 360)::BIGINT + 20) AS mask_y2 FROM r"""),
}
