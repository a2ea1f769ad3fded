"""Queries that match and align candidate tracks, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import match as m
from subtide.sources import adapters as a

WINDOWS = [30_000, 60_000]


def _both(f):
    return lambda s, d: f(a.references(s, d), a.candidate_cues(s, d))


def _several(c):
    """Up to three candidates for each reference: besides its own later ones, for two of three and for half of the references."""
    later = lambda ms: c.withColumns({"start_ms": F.col("start_ms") + ms, "end_ms": F.col("end_ms") + ms})
    return c.withColumn("cand_no", F.lit(0)).union(later(7000).where("pair_id % 3 <> 0").withColumn("cand_no", F.lit(1))).union(later(45_000).where("pair_id % 2 = 0").withColumn("cand_no", F.lit(2)))


QUERIES = {
    "j1_nearest_match": _both(lambda r, c: m.nearest_match(r, c, 2000)),
    "g7_line_match_score": _both(m.line_match_score),
    "g9_validate_candidates": _both(m.validate_candidates),
    "g9_validation_counts": _both(m.validation_counts),
    "j2_xcorr_pairs": _both(lambda r, c: m.xcorr_pairs(*m.paired_bins(r, c, 1000), 15)),
    "g8_similarity": _both(m.similarity),
    "l1_estimate_offset": _both(m.estimate_offset),
    "l2_align_plan": _both(m.align_plan),
    "l3_apply_shift": _both(lambda r, c: m.apply_shift(c, m.align_plan(r, c))),
    "g6_density_correlation": _both(lambda r, c: m.density_correlation(r, c, 30_000)),
    "j12_calibration_scores": _both(lambda r, c: m.calibration_scores(r, _several(c), WINDOWS)),
    "g10_calibration_summary": _both(lambda r, c: m.calibration_summary(m.calibration_scores(r, _several(c), WINDOWS))),
    "l4_best_candidates": _both(m.best_candidates),
}

NEAR = """near AS (SELECT c.pair_id, c.cue_no, c.start_ms, least(c.start_ms - b.start_ms, f.start_ms - c.start_ms) AS distance
  FROM {c} c ASOF LEFT JOIN refs b ON c.pair_id = b.pair_id AND c.start_ms >= b.start_ms ASOF LEFT JOIN refs f ON c.pair_id = f.pair_id AND c.start_ms <= f.start_ms)"""
SCORED = "{n} AS (SELECT pair_id, count_if(distance <= 2000)::BIGINT AS n_matched, count(*) AS n_cues, count_if(distance <= 2000)::DOUBLE / count(*) AS score FROM {t} GROUP BY pair_id)"


def _bins(name: str, side: str, ends: str, width: int) -> str:
    return f"""{name} AS (SELECT DISTINCT pair_id, unnest(range(f, l + 1)) AS bin FROM (SELECT pair_id, greatest(0, floor(start_ms / {width}.0)::BIGINT) AS f,
  least(ceil(duration / {width}.0)::BIGINT - 1, CASE WHEN end_ms > start_ms THEN floor((end_ms - 1) / {width}.0) ELSE floor(start_ms / {width}.0) END::BIGINT) AS l
  FROM {side} JOIN {ends} USING (pair_id)) WHERE l >= f)"""


def _offset(p: str, refs: str, cands: str, width: int, shift: str, least: float) -> str:
    """Expressions that end in {p}off (pair_id, offset_ms): all shifts of all bins counted one by one."""
    return f"""{p}ends AS (SELECT pair_id, greatest(0, max(e)) AS duration FROM (SELECT pair_id, end_ms AS e FROM {refs} UNION ALL SELECT pair_id, end_ms FROM {cands}) GROUP BY pair_id),
{_bins(p + 'rb', refs, p + 'ends', width)}, {_bins(p + 'cb', cands, p + 'ends', width)},
{p}lim AS (SELECT pair_id, least(({shift}) // {width}, ceil(duration / {width}.0)::BIGINT - 1) AS m FROM {p}ends WHERE pair_id IN (SELECT pair_id FROM {refs}) AND pair_id IN (SELECT pair_id FROM {cands})),
{p}cnt AS (SELECT r.pair_id, r.bin - c.bin AS shift, count(*) AS n FROM {p}rb r JOIN {p}cb c USING (pair_id) JOIN {p}lim USING (pair_id) WHERE abs(r.bin - c.bin) <= m GROUP BY ALL),
{p}best AS (SELECT *, (SELECT count(*) FROM {p}rb x WHERE x.pair_id = t.pair_id) AS re, (SELECT count(*) FROM {p}cb x WHERE x.pair_id = t.pair_id) AS ce FROM {p}cnt t QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, shift) = 1),
{p}off AS (SELECT pair_id, shift * {width} AS offset_ms, n, re, ce FROM {p}best WHERE n / sqrt((re * ce)::DOUBLE) >= {least})"""


PLAN = f"""gaps AS MATERIALIZED (SELECT pair_id, end_ms AS gap_start, gap_end FROM (SELECT *, lead(start_ms) OVER (PARTITION BY pair_id ORDER BY start_ms, cue_no) AS gap_end FROM refs)
  WHERE gap_end - end_ms >= 60000 AND end_ms BETWEEN 30000 AND 360000 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY gap_end - end_ms DESC, start_ms, cue_no) = 1),
rw AS (SELECT * FROM refs WHERE pair_id NOT IN (SELECT pair_id FROM gaps)), cw AS (SELECT * FROM cands WHERE pair_id IN (SELECT pair_id FROM rw)),
cg AS (SELECT * FROM cands WHERE pair_id IN (SELECT pair_id FROM gaps)),
rpre AS (SELECT refs.* FROM refs JOIN gaps USING (pair_id) WHERE end_ms <= gap_start), rpost AS (SELECT refs.* FROM refs JOIN gaps USING (pair_id) WHERE start_ms >= gap_end),
{_offset('w', 'rw', 'cw', 100, '15000', 0.4)}, {_offset('p', 'rpre', 'cg', 100, '15000', 0.2)},
{_offset('q', 'rpost', 'cg', 100, '(SELECT gap_end - gap_start + 30000 FROM gaps g WHERE g.pair_id = qends.pair_id)', 0.2)},
ab AS (SELECT pair_id, gap_start, gap_end, woff.offset_ms AS w, coalesce(poff.offset_ms, qoff.offset_ms) AS pa, coalesce(qoff.offset_ms, poff.offset_ms) AS pb
  FROM (SELECT DISTINCT pair_id FROM refs WHERE pair_id IN (SELECT pair_id FROM cands)) LEFT JOIN gaps USING (pair_id) LEFT JOIN woff USING (pair_id) LEFT JOIN poff USING (pair_id) LEFT JOIN qoff USING (pair_id)),
plan AS MATERIALIZED (SELECT pair_id, CASE WHEN abs(pa - pb) >= 150 THEN floor((gap_start - pa + gap_end - pb) / 2.0)::BIGINT END AS boundary_ms,
  coalesce(CASE WHEN gap_start IS NULL THEN CASE WHEN abs(w) >= 150 THEN w ELSE 0 END WHEN abs(pa - pb) >= 150 THEN CASE WHEN abs(pa) >= 150 THEN pa ELSE 0 END ELSE CASE WHEN abs(pb) >= 150 THEN pb ELSE 0 END END, 0) AS pre_ms,
  coalesce(CASE WHEN gap_start IS NULL THEN CASE WHEN abs(w) >= 150 THEN w ELSE 0 END ELSE CASE WHEN abs(pb) >= 150 THEN pb ELSE 0 END END, 0) AS post_ms FROM ab)"""
MOVED = """moved AS (SELECT pair_id, cue_no, start_ms + d AS start_ms, end_ms + d AS end_ms, text FROM (
  SELECT cands.*, coalesce(CASE WHEN start_ms < boundary_ms THEN pre_ms ELSE post_ms END, 0) AS d FROM cands LEFT JOIN plan USING (pair_id)))"""


def _density(p: str, refs: str, cands: str, window: int) -> str:
    return f"""{p}b AS (SELECT pair_id, ceil(max(e) / {window}.0)::BIGINT AS b FROM (SELECT pair_id, end_ms AS e FROM {refs} UNION ALL SELECT pair_id, end_ms FROM {cands}) GROUP BY pair_id
  HAVING pair_id IN (SELECT pair_id FROM {refs}) AND pair_id IN (SELECT pair_id FROM {cands}) AND max(e) > 0),
{p}s AS (SELECT pair_id, b, unnest(range(b)) AS bin FROM {p}b),
{p}r AS (SELECT pair_id, least(greatest(floor(start_ms / {window}.0)::BIGINT, 0), b - 1) AS bin, count(*) AS r FROM {refs} JOIN {p}b USING (pair_id) GROUP BY ALL),
{p}c AS (SELECT pair_id, least(greatest(floor(start_ms / {window}.0)::BIGINT, 0), b - 1) AS bin, count(*) AS c FROM {cands} JOIN {p}b USING (pair_id) GROUP BY ALL),
{p}d AS (SELECT pair_id, bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM {p}s LEFT JOIN {p}r USING (pair_id, bin) LEFT JOIN {p}c USING (pair_id, bin)),
{p}k AS (SELECT x.pair_id, k, count(*) AS n, corr(x.r, y.c) AS cr, stddev_pop(x.r) AS sr, stddev_pop(y.c) AS sc FROM {p}d x CROSS JOIN (VALUES (-1), (0), (1)) AS v(k) JOIN {p}d y ON x.pair_id = y.pair_id AND y.bin = x.bin - k GROUP BY ALL),
{p}score AS (SELECT pair_id, greatest(0, coalesce(max(CASE WHEN n >= 3 AND sr > 0 AND sc > 0 THEN cr END), 0))::DOUBLE AS score FROM {p}k GROUP BY pair_id)"""


MET = "kind || ':' || met.ref_id || ':' || met.cand_id || ':' || met.cand_no"
CAL = f"""several AS (SELECT *, 0 AS cand_no FROM cands UNION ALL SELECT * REPLACE (start_ms + 7000 AS start_ms, end_ms + 7000 AS end_ms), 1 FROM cands WHERE pair_id % 3 <> 0
  UNION ALL SELECT * REPLACE (start_ms + 45000 AS start_ms, end_ms + 45000 AS end_ms), 2 FROM cands WHERE pair_id % 2 = 0),
ids AS (SELECT DISTINCT pair_id FROM refs), found AS (SELECT DISTINCT pair_id, cand_no FROM several),
firsts AS (SELECT * FROM found WHERE pair_id IN (SELECT pair_id FROM ids ORDER BY pair_id LIMIT 8) QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY cand_no) <= 2),
met AS (SELECT 'CROSS' AS kind, i.pair_id AS ref_id, f.pair_id AS cand_id, cand_no FROM ids i JOIN firsts f ON i.pair_id <> f.pair_id UNION ALL SELECT 'OWN', pair_id, pair_id, cand_no FROM ids JOIN found USING (pair_id)),
mr AS (SELECT {MET} AS pair_id, start_ms, end_ms FROM met JOIN refs ON refs.pair_id = met.ref_id),
mc AS (SELECT {MET} AS pair_id, start_ms, end_ms FROM met JOIN several ON several.pair_id = met.cand_id AND several.cand_no = met.cand_no),
{_density('x', 'mr', 'mc', WINDOWS[0])}, {_density('y', 'mr', 'mc', WINDOWS[1])},
cal AS (SELECT kind, {WINDOWS[0]} AS "window", ref_id, cand_id, cand_no, score FROM xscore JOIN met ON pair_id = {MET}
  UNION ALL SELECT kind, {WINDOWS[1]}, ref_id, cand_id, cand_no, score FROM yscore JOIN met ON pair_id = {MET})"""
V = "cues refs cands"

ORACLES = {
    "j1_nearest_match": a.with_views(V, f", {NEAR.format(c='cands')} SELECT *, coalesce(distance <= 2000, false) AS matched FROM near"),
    "g7_line_match_score": a.with_views(V, f", {NEAR.format(c='cands')}, {SCORED.format(n='s', t='near')} SELECT * FROM s"),
    "g9_validate_candidates": a.with_views(V, f", {NEAR.format(c='cands')}, {SCORED.format(n='s', t='near')} SELECT pair_id, score FROM s WHERE score >= 0.5"),
    "g9_validation_counts": a.with_views(V, f", {NEAR.format(c='cands')}, {SCORED.format(n='s', t='near')} SELECT count_if(score >= 0.5)::BIGINT AS passed, count_if(score < 0.5)::BIGINT AS rejected, max(score) AS best FROM s"),
    "j2_xcorr_pairs": a.with_views(V, f", {_offset('w', 'refs', 'cands', 1000, '15000', 0)} SELECT * FROM wcnt"),
    "g8_similarity": a.with_views(V, f", {_offset('w', 'refs', 'cands', 2000, '30000', 0)} SELECT pair_id, least(1.0, n / sqrt((re * ce)::DOUBLE)) AS score FROM wbest"),
    "l1_estimate_offset": a.with_views(V, f", {_offset('w', 'refs', 'cands', 100, '15000', 0.4)} SELECT pair_id, offset_ms FROM woff"),
    "l2_align_plan": a.with_views(V, f", {PLAN} SELECT * FROM plan"),
    "l3_apply_shift": a.with_views(V, f", {PLAN}, {MOVED} SELECT * FROM moved"),
    "g6_density_correlation": a.with_views(V, f", {_density('x', 'refs', 'cands', 30_000)} SELECT * FROM xscore"),
    "j12_calibration_scores": a.with_views(V, f", {CAL} SELECT * FROM cal"),
    "g10_calibration_summary": a.with_views(V, f""", {CAL}, s AS (SELECT "window", min(score) FILTER (kind = 'OWN') AS min_own, avg(score) FILTER (kind = 'OWN') AS avg_own, max(score) FILTER (kind = 'OWN') AS max_own, count(*) FILTER (kind = 'OWN') AS n_own,
  min(score) FILTER (kind = 'CROSS') AS min_cross, avg(score) FILTER (kind = 'CROSS') AS avg_cross, max(score) FILTER (kind = 'CROSS') AS max_cross, count(*) FILTER (kind = 'CROSS') AS n_cross FROM cal GROUP BY "window")
SELECT *, min_own - max_cross AS gap, CASE WHEN min_own > max_cross THEN (min_own + max_cross) / 2 END AS threshold FROM s"""),
    "l4_best_candidates": a.with_views(V, f""", {PLAN}, {MOVED}, {NEAR.format(c='cands')}, {SCORED.format(n='s', t='near')}, {NEAR.replace('near AS', 'near2 AS').format(c='moved')}, {SCORED.format(n='s2', t='near2')}
SELECT plan.*, s.score AS score_before, s2.score AS score_after FROM plan JOIN s USING (pair_id) JOIN s2 USING (pair_id)"""),
}
