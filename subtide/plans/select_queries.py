"""Queries that choose and audit tracks and candidates, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.operators import runs, select as c
from subtide.session import fresh_path, table
from subtide.sources import adapters as a, documents


def _probes(s, d):
    t = a.tracks(s, d)
    stream = F.struct(F.col("stream_no").alias("index"), F.lit("subtitle").alias("codec_type"), F.col("codec").alias("codec_name"), F.struct(F.expr("nullif(language, 'und')").alias("language"), F.expr("nullif(track_name, '')").alias("title")).alias("tags"))
    video = F.from_json(F.lit('{"index":0,"codec_type":"video","r_frame_rate":"24000/1001"}'), "index int, codec_type string, r_frame_rate string")
    return t.groupBy("media_id").agg(F.array_sort(F.collect_list(stream)).alias("streams")).select("media_id", F.to_json(F.struct(F.col("streams").alias("streams"))).alias("probe"), video.alias("_v")).drop("_v")


def _expected(s, d):
    return a.tracks(s, d).where("NOT (media_id % 5 = 0 AND stream_no = 1)")


def _merged(s, d):
    x = a.candidates(s, d)
    return c.merge_candidates(x.where("hash_match"), x.where("NOT hash_match"))


def _source(s, d):
    x = a.candidates(s, d)
    fetched = c.best_per_language(x).where("language = 'eng'").select("media_id", F.concat(F.lit("f"), "result_no").alias("path"))
    m = x.select("media_id").distinct()
    return c.english_source(m, fetched, m.where("media_id % 3 = 0").select("media_id", F.lit("r").alias("path")), m.where("media_id % 2 = 0").select("media_id", F.lit("e").alias("path")))


def _assembled(s, d):
    x = a.candidates(s, d)
    m = x.select("media_id").distinct()
    ext = c.external_subs(a.media(s, d), a.manifest(s, d))
    return c.assemble_tracks(c.select_candidates(x).where("language = 'pol'"), m, ext)


def _scores(s, d):
    x = a.candidates(s, d)
    names = F.element_at(F.array(*[F.lit(n) for n in ("opensubtitles", "podnapisi", "napiprojekt", "animesub")]), (F.col("result_no") % 4 + 1).cast("int"))
    sim = F.when(F.col("result_no") % 3 > 0, F.col("score"))
    return x.select("result_no", c.provider_score(names, F.col("hash_match"), sim).alias("provider_score"))


#: What follows the base title in search results, by part modulo 10.
SUFFIXES = [" ep01", " 2 ep3", " S2 Arc ep3", " OVA ep1", " episode 12", " ep01-10", " Movie", " 3: Bonus ep1", " 10th ep2", " e4 e05 - 9"]


def _entries(s, d):
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (k % 10 + 1).cast("int"))
    return table(s, d, "part").select(k.alias("entry_no"), c.entry_matches(F.concat(F.upper("p_name"), suffix), F.col("p_name"), F.expr("nullif(p_partkey % 4, 0)"), k % 13).alias("matches"))


def _fonts(s, d):
    fonts = table(s, d, "supplier").select(F.col("s_name").alias("stem"), F.split("s_name", "").alias("letters"))
    styles = table(s, d, "customer").select(F.col("c_custkey").alias("media_id"), F.concat(F.lit("supplier#0000000"), F.col("c_custkey") % 40).alias("fontname"))
    return c.pick_font(styles, fonts, "1")


#: What parsers, folder and container say of a part's file, missing in turn.
PARSED = """SELECT p_partkey AS media_id, p_name || '.mkv' AS file_name, CASE WHEN p_partkey % 7 < 5 THEN p_brand END AS folder_name, CASE WHEN p_partkey % 11 = 0 THEN p_type WHEN p_partkey % 11 = 1 THEN '' END AS container_title,
  CASE WHEN p_partkey % 3 > 0 THEN upper(p_name) END AS ani_title, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 - 1 END AS ani_season, nullif(p_partkey % 5, 4) AS ani_episode, nullif(p_partkey % 6, 3) AS ani_year,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS release_group, p_partkey % 2 = 0 AS is_anime, CASE WHEN p_partkey % 9 > 3 THEN p_name END AS guess_title, nullif(p_partkey % 3, 2) AS guess_season, nullif(p_partkey % 8, 7) AS guess_episode,
  2000 + p_partkey % 20 AS guess_year, CASE WHEN p_partkey % 10 < 2 THEN 'episode' ELSE 'movie' END AS guess_type, CASE WHEN p_partkey % 13 > 6 THEN p_type END AS folder_title, p_partkey % 4 AS folder_season FROM part"""


def _parsed(s, d):
    table(s, d, "part").createOrReplaceTempView("part_of_identities")
    return s.sql(PARSED.replace("FROM part", "FROM part_of_identities"))


def _manifest(s, d):
    """The manifest of all media written as one document by many tasks, and read back."""
    media = a.media(s, d).select(
        "media_id", F.concat("parsed_title", F.lit(".mkv")).alias("source_file"), F.initcap("parsed_title").alias("title"), "parsed_title", "season", "episode", F.lit("episode").alias("media_type"), (F.col("media_id") % 2 == 0).alias("is_anime")
    )
    path = fresh_path(s, "manifest") + ".json"
    documents.write_manifest(media, a.tracks(s, d), path, "/videos")
    sub = "array<struct<stream_no:int,file:string,language:string>>"
    entry = f"struct<source_file:string,identity:struct<title:string,parsed_title:string,season:bigint,episode:bigint,media_type:string,is_anime:boolean>,subtitles:{sub}>"
    read = documents.read_document(s, path, entry, "version int, source_dir string")
    e = read.select("version", "source_dir", "entry_no", "e.source_file", "e.identity.*", F.array_join("e.subtitles.file", ",").alias("files"), F.array_join("e.subtitles.language", ",").alias("languages"))
    return e.drop("title")


def _fetched(s, d):
    x = a.candidates(s, d)
    return runs.fetch_summary(x, x.where("result_no % 3 > 0"))


def _embedded(s, d):
    fonts = table(s, d, "supplier").select((F.col("s_suppkey") % 50).alias("media_id"), F.split("s_name", "").alias("letters"))
    return c.embedded_font_covers(fonts, "19")


QUERIES = {
    "p16_entry_matches": _entries,
    "j11_pick_font": _fonts,
    "g17_fetch_summary": _fetched,
    "j11_embedded_fonts": _embedded,
    "s7_explode_streams": lambda s, d: c.explode_streams(_probes(s, d)),
    "p3_signs_track_name": lambda s, d: a.tracks(s, d).select("media_id", "stream_no", c.signs_track_name(F.col("track_name")).alias("signs"), c.signs_track_short(F.col("track_name")).alias("signs_short")),
    "p19_code_maps": lambda s, d: a.tracks(s, d).select("media_id", "stream_no", c.codec_extension(F.col("codec")).alias("ext"), c.language_code(F.col("language")).alias("lang"), c.codec_kind(F.col("codec")).alias("kind")),
    "w13_english_track": lambda s, d: c.english_track(a.tracks(s, d)),
    "j8_todo_media": lambda s, d: c.todo_media(a.tracks(s, d)),
    "j9_new_only": lambda s, d: c.new_only(a.tracks(s, d).select("media_id").distinct(), table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("media_id")), "media_id"),
    "j10_audit_tracks": lambda s, d: c.audit_tracks(a.tracks(s, d), _expected(s, d)),
    "s14_build_manifest": lambda s, d: c.build_manifest(a.tracks(s, d)),
    "s14_write_manifest": _manifest,
    "p17_merge_identity": lambda s, d: c.merge_identity(_parsed(s, d)),
    "j4_external_subs": lambda s, d: c.external_subs(a.media(s, d), a.manifest(s, d)),
    "p18_output_stem": lambda s, d: a.media(s, d).select("media_id", c.output_stem(F.col("parsed_title"), F.col("season"), F.col("episode")).alias("stem")),
    "j6_english_source": _source,
    "j7_merge_candidates": _merged,
    "w11_select_candidates": lambda s, d: c.select_candidates(a.candidates(s, d)),
    "t1_rank_all": lambda s, d: a.candidates(s, d).orderBy(F.desc("score"), F.desc("hash_match"), "source", "subtitle_id", "result_no"),
    "t2_best_per_language": lambda s, d: c.best_per_language(a.candidates(s, d)),
    "t3_first_candidates": lambda s, d: c.first_candidates(a.candidates(s, d), 3),
    "u1_union_results": lambda s, d: a.candidates(s, d).where("hash_match").unionByName(a.candidates(s, d).where("NOT hash_match")),
    "u2_except_results": lambda s, d: a.candidates(s, d).select("media_id", "source", "subtitle_id").exceptAll(a.candidates(s, d).where("hash_match").select("media_id", "source", "subtitle_id")),
    "w14_assemble_tracks": _assembled,
    "p15_provider_score": _scores,
}

SIGNS = r"(lower(track_name) NOT IN ('', 'default', 'ass', 'subtitle', 'subtitles') AND regexp_matches(lower(track_name), '\b(?:sign|song|title|op|ed|insert|inro|inen)s?\b'))"
KIND = "CASE WHEN regexp_matches(codec, '^(hdmv_pgs|dvd_sub|dvb_sub|s_hdmv|s_vobsub|pgs|vobsub)') THEN 'image' ELSE 'text' END"
EXT = "CASE codec WHEN 'ass' THEN '.ass' WHEN 'webvtt' THEN '.vtt' ELSE '.srt' END"
LANG = "CASE language WHEN 'pol' THEN 'pl' ELSE 'en' END"
RANK = "row_number() OVER (PARTITION BY {0} ORDER BY score DESC, hash_match DESC, source, subtitle_id, result_no)"
T, C = "tracks", "candidates"

SEASON = r"""CASE WHEN i IN (0, 5, 8) AND suffix[2:3] = 'ep' OR i = 4 THEN 1 WHEN i IN (3, 6, 7) THEN NULL ELSE try_cast(regexp_extract(lower(suffix[2:]), '^s?(\d+)([^\p{L}\p{N}_]|$)', 1) AS INT) END"""
ORACLES = {
    "p16_entry_matches": rf"""WITH x AS (SELECT p_partkey AS k, p_partkey % 10 AS i, {SUFFIXES!r}[p_partkey % 10 + 1] AS suffix, nullif(p_partkey % 4, 0) AS season, p_partkey % 13 AS e, lower(p_name) AS n FROM part),
y AS (SELECT *, {SEASON} AS own, lower(n || suffix) AS low FROM x),
z AS (SELECT *, list_transform(regexp_extract_all(low, '(?:ep|episode\s*|e)(\d+)', 1), lambda v: v::INT) AS one, regexp_extract_all(low, '(?:ep|episode\s*|e)(\d+)\s*-\s*(\d+)', 1) AS lo, regexp_extract_all(low, '(?:ep|episode\s*|e)(\d+)\s*-\s*(\d+)', 2) AS hi FROM y)
SELECT k AS entry_no, (list_contains(one, e) OR len(lo) > 0 AND e BETWEEN lo[1]::INT AND hi[1]::INT) AND (season IS NULL OR coalesce(own = season, false)) AS matches FROM z""",
    "j11_pick_font": """WITH good AS (SELECT s_name AS stem FROM supplier WHERE contains(s_name, '1'))
SELECT c_custkey AS media_id, 'supplier#0000000' || (c_custkey % 40) AS fontname, coalesce((SELECT min(stem) FROM good WHERE starts_with(lower(stem), 'supplier#0000000' || (c_custkey % 40))), (SELECT min(stem) FROM good)) AS stem FROM customer""",
    "g17_fetch_summary": a.with_views(C, """, x AS (SELECT source, EXISTS (SELECT 1 FROM candidates f WHERE f.result_no % 3 > 0 AND f.media_id = c.media_id AND f.source = c.source AND f.subtitle_id = c.subtitle_id) AS there FROM candidates c)
SELECT source, count(*) AS found, count_if(there)::BIGINT AS downloaded, count_if(NOT there)::BIGINT AS failed FROM x GROUP BY source"""),
    "j11_embedded_fonts": "SELECT s_suppkey % 50 AS media_id, bool_or(contains(s_name, '1') AND contains(s_name, '9')) AS covered FROM supplier GROUP BY 1",
    "s7_explode_streams": a.with_views(T, " SELECT media_id, stream_no, (row_number() OVER (PARTITION BY media_id ORDER BY stream_no) - 1)::INT AS subtitle_index, codec, language, track_name FROM tracks"),
    "p3_signs_track_name": a.with_views(T, f" SELECT media_id, stream_no, {SIGNS} AS signs, regexp_matches(lower(track_name), 'sign|song|op|ed') AS signs_short FROM tracks"),
    "p19_code_maps": a.with_views(T, f" SELECT media_id, stream_no, {EXT} AS ext, {LANG} AS lang, {KIND} AS kind FROM tracks"),
    "w13_english_track": a.with_views(T, f" SELECT *, {KIND} AS kind FROM tracks WHERE language IN ('eng', 'und') AND NOT {SIGNS} QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY {KIND} = 'image', stream_no) = 1"),
    "j8_todo_media": a.with_views(T, " SELECT media_id FROM tracks GROUP BY media_id HAVING count(*) FILTER (language = 'pol') = 0"),
    "j9_new_only": a.with_views(T, " SELECT DISTINCT media_id FROM tracks WHERE media_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"),
    "j10_audit_tracks": a.with_views(T, """, x AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY stream_no) AS pos, language FROM tracks), y AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY stream_no) AS pos, language FROM tracks WHERE NOT (media_id % 5 = 0 AND stream_no = 1)),
z AS (SELECT media_id, count(x.language) AS n_actual, count(y.language) AS n_expected, bool_and(coalesce(x.language = y.language, false)) AS languages_equal FROM x FULL JOIN y USING (media_id, pos) GROUP BY media_id) SELECT *, n_actual = n_expected AND languages_equal AS ok FROM z"""),
    "s14_build_manifest": a.with_views(T, f""" SELECT media_id, '{{"subtitles":[' || string_agg('{{"stream_no":' || stream_no || ',"file":"' || stream_no || {EXT} || '","language":"' || {LANG} || '"}}', ',' ORDER BY stream_no) || ']}}' AS doc FROM tracks GROUP BY media_id"""),
    "s14_write_manifest": a.with_views("media tracks", f""", x AS (SELECT media_id, string_agg(stream_no || {EXT}, ',' ORDER BY stream_no) AS files, string_agg({LANG}, ',' ORDER BY stream_no) AS languages FROM tracks GROUP BY media_id)
SELECT 1 AS version, '/videos' AS source_dir, (row_number() OVER (ORDER BY parsed_title || '.mkv', media_id) - 1)::INT AS entry_no, parsed_title || '.mkv' AS source_file, parsed_title, season, episode, 'episode' AS media_type, media_id % 2 = 0 AS is_anime,
  coalesce(files, '') AS files, coalesce(languages, '') AS languages FROM media LEFT JOIN x USING (media_id)"""),
    "p17_merge_identity": f"""WITH p AS ({PARSED}),
t AS (SELECT *, CASE WHEN is_anime AND ani_title IS NOT NULL THEN ani_title ELSE coalesce(guess_title, ani_title) END AS parsed,
  CASE WHEN is_anime THEN CASE WHEN ani_season > 0 THEN ani_season ELSE guess_season END ELSE CASE WHEN guess_season > 0 THEN guess_season ELSE ani_season END END AS s,
  CASE WHEN is_anime THEN CASE WHEN ani_episode > 0 THEN ani_episode ELSE guess_episode END ELSE CASE WHEN guess_episode > 0 THEN guess_episode ELSE ani_episode END END AS episode FROM p),
u AS (SELECT *, coalesce(parsed, CASE WHEN folder_name IS NOT NULL THEN coalesce(folder_title, folder_name) END) AS parsed_title, CASE WHEN parsed IS NULL AND folder_name IS NOT NULL AND coalesce(s, 0) = 0 THEN folder_season ELSE s END AS season FROM t)
SELECT media_id, coalesce(nullif(container_title, ''), parsed_title, file_name) AS title, parsed_title, CASE WHEN ani_year > 0 THEN ani_year ELSE guess_year END AS year, season, episode,
  CASE WHEN season IS NOT NULL OR episode IS NOT NULL OR guess_type = 'episode' THEN 'episode' ELSE 'movie' END AS media_type, is_anime, release_group FROM u""",
    "j4_external_subs": a.with_views("media manifest", " SELECT m.media_id, f.media_id AS manifest_id, m.episode, contains(lower(m.parsed_title), lower(f.parsed_title)) OR contains(lower(f.parsed_title), lower(m.parsed_title)) AS title_match FROM media m JOIN manifest f USING (folder, episode)"),
    "p18_output_stem": a.with_views("media", r" SELECT media_id, trim(regexp_replace(parsed_title, '[^\p{L}\p{N} _-]', '', 'g')) || CASE WHEN season IS NOT NULL THEN printf(' - S%02dE%02d', season, episode) ELSE printf(' - E%02d', episode) END AS stem FROM media"),
    "j6_english_source": a.with_views(C, f""", best AS (SELECT media_id, 'f' || result_no AS p FROM (SELECT *, {RANK.format('media_id, language')} AS r FROM candidates) WHERE r = 1 AND language = 'eng')
SELECT media_id, coalesce(p, CASE WHEN media_id % 3 = 0 THEN 'r' WHEN media_id % 2 = 0 THEN 'e' END) AS path, CASE WHEN p IS NOT NULL THEN 'fetched' WHEN media_id % 3 = 0 THEN 'reference' WHEN media_id % 2 = 0 THEN 'embedded' ELSE 'error' END AS origin
FROM (SELECT DISTINCT media_id FROM candidates) LEFT JOIN best USING (media_id)"""),
    "j7_merge_candidates": a.with_views(C, """ SELECT * FROM candidates WHERE hash_match UNION ALL
(SELECT * FROM candidates c WHERE NOT hash_match AND NOT EXISTS (SELECT 1 FROM candidates h WHERE h.hash_match AND h.media_id = c.media_id AND h.source = c.source AND h.subtitle_id = c.subtitle_id) QUALIFY row_number() OVER (PARTITION BY media_id, source, subtitle_id ORDER BY result_no) = 1)"""),
    "w11_select_candidates": a.with_views(C, f" SELECT * FROM (SELECT *, {RANK.format('media_id, language')}::INT AS rank FROM candidates) WHERE rank = 1 OR score >= 0.8"),
    "t1_rank_all": a.with_views(C, " SELECT * FROM candidates"),
    "t2_best_per_language": a.with_views(C, f" SELECT * EXCLUDE (r) FROM (SELECT *, {RANK.format('media_id, language')} AS r FROM candidates) WHERE r = 1"),
    "t3_first_candidates": a.with_views(C, f" SELECT * FROM (SELECT *, {RANK.format('media_id')}::INT AS rank FROM candidates) WHERE rank <= 3"),
    "u1_union_results": a.with_views(C, " SELECT * FROM candidates"),
    "u2_except_results": a.with_views(C, " SELECT media_id, source, subtitle_id FROM candidates EXCEPT ALL SELECT media_id, source, subtitle_id FROM candidates WHERE hash_match"),
    "w14_assemble_tracks": a.with_views("candidates media manifest", f""", u AS (SELECT media_id, 0 AS k, r AS o, 'Polish (' || source || ')' AS title FROM (SELECT *, {RANK.format('media_id, language')} AS r FROM candidates) WHERE language = 'pol' AND (r = 1 OR score >= 0.8)
  UNION ALL SELECT DISTINCT media_id, 1, 0, 'Polish (AI)' FROM candidates UNION ALL SELECT m.media_id, 2, f.media_id, 'External' FROM media m JOIN manifest f USING (folder, episode)),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY k, o)::INT AS track_no FROM u) SELECT media_id, track_no, title, track_no = 1 AND k < 2 AS is_default FROM n"""),
    "p15_provider_score": a.with_views(C, """ SELECT result_no, CASE result_no % 4 WHEN 0 THEN CASE WHEN hash_match THEN 1.0 WHEN result_no % 3 > 0 THEN 0.6::DOUBLE + 0.3::DOUBLE * score ELSE 0.7 END
  WHEN 1 THEN CASE WHEN hash_match THEN 0.9 ELSE 0.65 END WHEN 2 THEN 0.95 ELSE 0.6 END::DOUBLE AS provider_score FROM candidates"""),
}
