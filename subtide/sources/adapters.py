"""Views of the parquet tables as timed-text tables, for Spark and (``SQL``) for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from subtide.session import table
from subtide.sources.ass import EVENT_FORMAT, ass_clock, ass_events, ass_lines

STYLE_FORMAT = "Format: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Alignment, MarginL, MarginR, MarginV"


def _seconds() -> Column:
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of one track per user: the event's second since 2024 read as a millisecond."""
    start = _seconds()
    return table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("cue_no"),
        start.alias("start_ms"),
        (start + 500 + F.col("event_id") * 37 % 3000).alias("end_ms"),
        F.col("event_type").alias("style"),
        F.concat(F.when(F.col("event_id") % 7 == 0, r"{\pos(960,100)}").otherwise(""), F.col("props")).alias("raw_text"),
        F.col("event_type").alias("text"),
    )


def ass_files(spark: SparkSession, sf: str) -> DataFrame:
    """An ASS file per user: a style per kind of event with its own font, size and margins, and an event per event."""
    e = cues(spark, sf)
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    font = F.element_at(F.array(*[F.lit(x) for x in ("Arial", "Open Sans", "My-Font")]), (F.col("track_id") % 3 + 1).cast("int"))
    n = F.length("style")
    styles = e.select("track_id", "style").distinct().select(
        "track_id", "style", of("Style: ", F.col("style"), ",", font, ",", 20 + F.col("track_id") % 30, ",&H00FFFFFF,", F.when(n % 2 == 0, -1).otherwise(0), ",0,", F.col("track_id") % 9 + 1, ",", F.col("track_id") % 50, ",10,", n).alias("l")
    )
    k = F.col("cue_no")
    line = of(F.when(k % 11 == 0, "Comment: ").otherwise("Dialogue: "), k % 3, ",", ass_clock(F.col("start_ms")), ",", ass_clock(F.col("end_ms")), ",", F.col("style"), ",N", k % 4, ",", F.col("track_id") % 20, ",0,", k % 50, ",", F.when(k % 13 == 0, "fade").otherwise(""), ",", F.col("raw_text"), F.col("style"), r", \N", F.col("style"))
    joined = lambda df, by: df.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "l"))), lambda x: x["l"]), "\n").alias(f"{by}s"))
    both = joined(styles, "style").join(joined(e.select("track_id", "cue_no", line.alias("l")), "cue_no"), "track_id")
    head = of("[Script Info]\nTitle: ", F.col("track_id"), f"\nScriptType: v4.00+\nPlayResX: 1920\n\n[V4+ Styles]\n{STYLE_FORMAT}\n")
    return both.select("track_id", of(head, F.col("styles"), f"\n\n[Events]\n{EVENT_FORMAT}\n", F.col("cue_nos"), "\n").alias("text"))


def ass_cues(spark: SparkSession, sf: str) -> DataFrame:
    """The events of these files."""
    return ass_events(ass_lines(ass_files(spark, sf)))


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one track per document of whatever language, cut after commas and full stops."""
    docs = table(spark, sf, "documents")
    pieces = F.split(F.regexp_replace("text", r"([,.])\s+", "$1\n"), "\n")
    return docs.select(F.col("doc_id").alias("track_id"), F.posexplode(pieces).alias("n", "text")).select(
        "track_id", F.col("n").cast("long").alias("cue_no"), (F.col("n").cast("long") * 2000).alias("start_ms"), (F.col("n").cast("long") * 2000 + 1800).alias("end_ms"), "text"
    )


def ocr_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised text of sampled frames; a view shows none."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("media_id"), F.col("event_id").alias("frame_no"), _seconds().alias("ts_ms"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text")
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Gray frames of one video per label, with a subtitle box on two of three."""
    vecs = table(spark, sf, "embeddings")
    no = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    box = F.struct(F.lit(0.1).alias("x"), (F.lit(0.7) + (F.col("vec_id") % 5) / F.lit(50.0)).alias("y"), F.lit(0.8).alias("width"), F.lit(0.1).alias("height"))
    return vecs.select(
        F.col("label").alias("media_id"), no.alias("frame_no"), (no * 333).alias("ts_ms"), F.transform("embedding", lambda x: F.floor((x.cast("double") + F.lit(0.6)) * 200).cast("int")).alias("pixels"),
        (F.col("vec_id") % 3 != 0).alias("has_subtitle"), F.array(box).alias("boxes"), "vec_id",
    )


def references(spark: SparkSession, sf: str) -> DataFrame:
    return cues(spark, sf).withColumnRenamed("track_id", "pair_id")


def candidate_cues(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate per reference: another track, or the same one moved as a whole or in two parts; every fifth cue is late besides."""
    late = F.when(F.col("cue_no") % 5 == 0, 2500).otherwise(0)
    own = cues(spark, sf).withColumns({"start_ms": F.col("start_ms") + late, "end_ms": F.col("end_ms") + late}).withColumnRenamed("track_id", "pair_id")
    other = own.withColumn("pair_id", F.col("pair_id") - 1).where("pair_id % 4 = 0 AND pair_id >= 0")
    shift = F.expr("CASE pair_id % 4 WHEN 1 THEN -1700 WHEN 2 THEN -3400 ELSE CASE WHEN start_ms >= 400000 THEN -90000 ELSE -500 END END")
    moved = own.where("pair_id % 4 != 0").withColumn("d", shift).withColumns({"start_ms": F.col("start_ms") + F.col("d"), "end_ms": F.col("end_ms") + F.col("d")}).drop("d")
    return other.unionByName(moved)


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a run before and one after mid-January, one video per user."""
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("error."), F.col("event_id") % 3)).otherwise(F.col("event_type"))
    run = F.when(F.expr("CAST(ts AS TIMESTAMP_NTZ) < TIMESTAMP_NTZ'2024-01-16 00:00:00'"), "before").otherwise("after")
    return (
        table(spark, sf, "events")
        .select(run.alias("run"), F.col("user_id").alias("video_id"), F.col("event_id").alias("span_no"), name.alias("name"), (F.col("value") * 10).alias("duration_ms"), F.col("event_type").alias("status"), "ts")
        .where("NOT (name = 'view' AND run = 'before' AND video_id % 10 = 0)")
    )


def media(spark: SparkSession, sf: str) -> DataFrame:
    """A video per part, fifty to a folder."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("media_id"), F.expr("p_partkey DIV 50").alias("folder"), F.col("p_name").alias("parsed_title"), F.expr("nullif(p_size % 4, 0)").alias("season"), F.col("p_size").alias("episode")
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """An entry of its folder's manifest per part: every third one with the first word of the title, the others with the whole in capitals."""
    title = F.when(F.col("media_id") % 3 == 0, F.split_part("parsed_title", F.lit(" "), F.lit(1))).otherwise(F.upper("parsed_title"))
    return media(spark, sf).withColumn("parsed_title", title)


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitle streams of one video per order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pick = lambda e, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (e + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.row_number().over(w).alias("stream_no"),
        F.when(F.col("l_returnflag") == "A", "eng").when(F.col("l_returnflag") == "N", "und").otherwise("pol").alias("language"),
        pick(F.col("l_quantity").cast("long") % 4, "ass", "subrip", "hdmv_pgs_subtitle", "webvtt").alias("codec"),
        pick(F.col("l_suppkey") % 3, "", "Full Dialogue", "Signs & Songs").alias("track_name"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitle search results of one video per customer."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("media_id"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 5).alias("subtitle_id"), F.col("o_orderkey").alias("result_no"),
        F.when(F.col("o_orderstatus") == "F", "eng").otherwise("pol").alias("language"), F.col("o_orderpriority").alias("release_name"), F.lit("srt").alias("format"),
        (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderkey") % 7 == 0).alias("hash_match"),
    )


#: The same views as common table expressions for DuckDB.
SQL = {
    "cues": """cues AS (SELECT user_id AS track_id, event_id AS cue_no, date_diff('second', TIMESTAMP '2024-01-01', ts) AS start_ms,
  date_diff('second', TIMESTAMP '2024-01-01', ts) + 500 + event_id * 37 % 3000 AS end_ms, event_type AS style,
  CASE WHEN event_id % 7 = 0 THEN '{\\pos(960,100)}' ELSE '' END || props AS raw_text, event_type AS text FROM events)""",
    "ass": """ass_ev AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY cue_no) AS cue_no, (cue_no % 3)::INT AS layer, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, style, 'N' || (cue_no % 4) AS name,
  (track_id % 20)::INT AS margin_l, 0 AS margin_r, (cue_no % 50)::INT AS margin_v, CASE WHEN cue_no % 13 = 0 THEN 'fade' ELSE '' END AS effect, cue_no % 11 = 0 AS is_comment, raw_text || style || ', \\N' || style AS raw_text FROM cues),
ass_st AS (SELECT DISTINCT track_id, style, ['Arial', 'Open Sans', 'My-Font'][track_id % 3 + 1] AS fontname, 20 + track_id % 30 AS fontsize, track_id % 9 + 1 AS alignment, length(style) % 2 = 0 AS bold, false AS italic,
  track_id % 50 AS margin_l, 10 AS margin_r, length(style) AS margin_v FROM cues)""",
    "lines": """lines AS (SELECT track_id, lang, n - 1 AS cue_no, (n - 1) * 2000 AS start_ms, (n - 1) * 2000 + 1800 AS end_ms, text FROM (
  SELECT doc_id AS track_id, lang, unnest(string_split(regexp_replace(text, '([,.])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS text,
    generate_subscripts(string_split(regexp_replace(text, '([,.])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) AS n FROM documents))""",
    "ocr": """ocr AS (SELECT user_id AS media_id, event_id AS frame_no, date_diff('second', TIMESTAMP '2024-01-01', ts) AS ts_ms,
  CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS text FROM events)""",
    "frames": """frames AS (SELECT label AS media_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no,
  333 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS ts_ms,
  list_transform(embedding, lambda x: floor((x::DOUBLE + 0.6::DOUBLE) * 200)::INT) AS pixels, vec_id % 3 <> 0 AS has_subtitle,
  0.1::DOUBLE AS x, 0.7::DOUBLE + (vec_id % 5) / 50.0::DOUBLE AS y, 0.8::DOUBLE AS width, 0.1::DOUBLE AS height, vec_id FROM embeddings)""",
    "refs": "refs AS (SELECT track_id AS pair_id, * EXCLUDE (track_id) FROM cues)",
    "cands": """late AS (SELECT *, CASE WHEN cue_no % 5 = 0 THEN 2500 ELSE 0 END AS late FROM cues), cands AS (
  SELECT track_id - 1 AS pair_id, * EXCLUDE (track_id, late) REPLACE (start_ms + late AS start_ms, end_ms + late AS end_ms) FROM late WHERE (track_id - 1) % 4 = 0 AND track_id >= 1
  UNION ALL
  SELECT track_id, cue_no, start_ms + d, end_ms + d, style, raw_text, text FROM (
    SELECT *, CASE track_id % 4 WHEN 1 THEN -1700 WHEN 2 THEN -3400 ELSE CASE WHEN start_ms >= 400000 THEN -90000 ELSE -500 END END AS d
    FROM (SELECT * REPLACE (start_ms + late AS start_ms, end_ms + late AS end_ms) FROM late) WHERE track_id % 4 <> 0))""",
    "spans": """spans AS (SELECT * FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS run, user_id AS video_id, event_id AS span_no,
  CASE WHEN event_type = 'error' THEN 'error.' || (event_id % 3) ELSE event_type END AS name, value * 10 AS duration_ms, event_type AS status, ts FROM events)
  WHERE NOT (name = 'view' AND run = 'before' AND video_id % 10 = 0))""",
    "media": "media AS (SELECT p_partkey AS media_id, p_partkey // 50 AS folder, p_name AS parsed_title, nullif(p_size % 4, 0) AS season, p_size AS episode FROM part)",
    "manifest": "manifest AS (SELECT * REPLACE (CASE WHEN media_id % 3 = 0 THEN split_part(parsed_title, ' ', 1) ELSE upper(parsed_title) END AS parsed_title) FROM media)",
    "tracks": """tracks AS (SELECT l_orderkey AS media_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS stream_no,
  CASE l_returnflag WHEN 'A' THEN 'eng' WHEN 'N' THEN 'und' ELSE 'pol' END AS language,
  ['ass', 'subrip', 'hdmv_pgs_subtitle', 'webvtt'][l_quantity::BIGINT % 4 + 1] AS codec, ['', 'Full Dialogue', 'Signs & Songs'][l_suppkey % 3 + 1] AS track_name FROM lineitem)""",
    "candidates": """candidates AS (SELECT o_custkey AS media_id, o_orderpriority AS source, o_orderkey % 5 AS subtitle_id, o_orderkey AS result_no,
  CASE WHEN o_orderstatus = 'F' THEN 'eng' ELSE 'pol' END AS language, o_orderpriority AS release_name, 'srt' AS format,
  o_totalprice / 500000 AS score, o_orderkey % 7 = 0 AS hash_match FROM orders)""",
}


def with_views(names: str, rest: str) -> str:
    """A query over the named views (blank-separated, in order of use): ``rest`` continues the list of table expressions."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + rest
