"""Operators on cue tables: cleaning, styles, activity, gaps, coverage.

A cue table has track_id, cue_no (file order), start_ms, end_ms, text, and for styled tracks style and raw_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Words that mark a style as no dialogue wherever they occur in its name.
NON_DIALOGUE = ("sign", "song", "title", "op", "ed", "insert", "inro", "inen")

# The characters of (?U)\s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trimmed(text: Column) -> Column:
    """The same without a pattern, by the characters it means; for texts of a line, since it notes where each character lies."""
    return F.btrim(text, F.lit(SPACES))


def stripped_column(name: str) -> Column:
    """The same of a column by name: only text with white space at an end meets the pattern that looks through all of it."""
    text = F.col(name)
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), stripped(text)).otherwise(text)


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def non_dialogue_style(style: Column) -> Column:
    """The name contains one of NON_DIALOGUE; false for null."""
    return F.coalesce(F.lower(style).rlike("|".join(NON_DIALOGUE)), F.lit(False))


def plain_text(raw: Column) -> Column:
    """Text of an event without override blocks, with line breaks for ``\\N`` and ``\\n`` and a space for ``\\h``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\{[^}]*\}", ""), r"\\[Nn]", "\n"), r"\\h", " ")


#: What events of styled files have besides; kept where a cue table has it.
EVENT_FIELDS = ("layer", "name", "effect", "is_comment", "margin_l", "margin_r", "margin_v")


def event_features(cues: DataFrame, preview: int = 80) -> DataFrame:
    """Per cue: duration, which override tags its raw text has, and those of EVENT_FIELDS that ``cues`` has."""
    raw = F.col("raw_text")
    has = lambda *tags: F.coalesce(raw.rlike("|".join(tags)), F.lit(False))
    return cues.select(
        "track_id", "cue_no", "style",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        has(r"\\pos\(").alias("has_pos"), has(r"\\move\(").alias("has_move"), has(r"\\i?clip\(").alias("has_clip"),
        has(r"\\[kK]").alias("has_karaoke"), has(r"\\an[1-9]").alias("has_an_override"), has(r"\\p[1-9]").alias("is_drawing"),
        F.length(plain_text(raw)).alias("text_length"), F.substring(plain_text(raw), 1, preview).alias("preview"), *[c for c in EVENT_FIELDS if c in cues.columns],
    )


def style_stats(cues: DataFrame) -> DataFrame:
    """Sums and shares of event features per track and style."""
    f = event_features(cues)
    flags = ("has_pos", "has_move", "has_clip", "has_karaoke", "has_an_override", "is_drawing")
    sums = f.groupBy("track_id", "style").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms"), F.sum("text_length").alias("total_length"), *[F.count_if(F.col(x)).alias(f"n_{x}") for x in flags]
    )
    n = F.col("n")
    return sums.withColumns({"avg_ms": F.col("total_ms") / n, "avg_length": F.col("total_length") / n, "pos_share": (F.col("n_has_pos") + F.col("n_has_move")) / n, "karaoke_share": F.col("n_has_karaoke") / n})


def classify_styles(cues: DataFrame) -> DataFrame:
    """Per track and style over its non-blank events: count, mean text length, mean duration, share of placed events, and whether it is dialogue.

    Placed styles are dialogue only with long texts and durations; many tiny texts or many quick events are karaoke.
    """
    raw = F.col("raw_text")
    kept = cues.where(~is_blank(raw)).withColumns({"_l": F.length(stripped(plain_text(raw))), "_p": raw.rlike(r"\\(pos|move)\("), "_d": F.col("end_ms") - F.col("start_ms")})
    m = kept.groupBy("track_id", "style").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("_l") / F.count(F.lit(1))).alias("avg_text"), (F.sum("_d") / F.count(F.lit(1))).alias("avg_ms"), (F.count_if("_p") / F.count(F.lit(1))).alias("pos_share")
    )
    n, text, ms, pos = (F.col(c) for c in ("n", "avg_text", "avg_ms", "pos_share"))
    verdict = F.when(pos >= 0.5, (text > 20) & (ms > 1500)).when((text < 5) & (n > 50), False).when((n > 500) & (ms < 500), False).otherwise(True)
    return m.withColumn("is_dialogue", verdict)


def dialogue_spans(cues: DataFrame) -> DataFrame:
    """Non-blank cues of styles that are dialogue by shape and by name, with the track's duration (largest end)."""
    good = classify_styles(cues).where("is_dialogue").select("track_id", "style")
    ends = cues.groupBy("track_id").agg(F.max("end_ms").alias("duration_ms"))
    spans = cues.where(~is_blank(F.col("raw_text")) & ~non_dialogue_style(F.col("style"))).join(good, ["track_id", "style"])
    return spans.join(ends, "track_id").select("track_id", "cue_no", "start_ms", "end_ms", F.greatest("duration_ms", F.lit(0)).alias("duration_ms"))


def bin_range(start: Column, end: Column, bins: Column, width: int) -> tuple[Column, Column]:
    """First and last bin that a span touches: its end is exclusive, a span without length touches its start's."""
    first = F.greatest(F.lit(0), F.floor(start / width))
    last = F.least(bins - 1, F.when(end > start, F.floor((end - 1) / width)).otherwise(F.floor(start / width)))
    return first, last


def activity_bins(spans: DataFrame, width: int, key: str = "track_id", duration: str = "duration_ms") -> DataFrame:
    """Distinct (key, bin) touched by the spans; bins run up to the duration."""
    first, last = bin_range(F.col("start_ms"), F.col("end_ms"), F.ceil(F.col(duration) / width), width)
    return spans.select(key, first.alias("_f"), last.alias("_l")).where("_l >= _f").select(key, F.explode(F.sequence("_f", "_l")).alias("bin")).distinct()


def density_bins(spans: DataFrame, window: int, key: str = "track_id", duration: str = "duration_ms") -> DataFrame:
    """Events that start in each window of a track, empty windows too; starts past the end count in the last."""
    bins = F.ceil(F.col(duration) / window)
    counts = spans.where(bins > 0).groupBy(key, F.least(F.floor(F.col("start_ms") / window), bins - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = spans.groupBy(key).agg(F.max(duration).alias(duration)).where(bins > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), bins - 1)).alias("bin"))
    return spine.join(counts, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dedup_cues(cues: DataFrame) -> DataFrame:
    """Drops cues of fewer than two characters, then merges runs of equal text: the first one's start and style, the latest end."""
    order = Window.partitionBy("track_id").orderBy("cue_no")
    kept = cues.withColumn("text", stripped(F.col("text"))).where(F.length("text") >= 2)
    new = F.coalesce(F.lag("text").over(order) != F.col("text"), F.lit(True)).cast("long")
    runs = kept.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    first = F.min_by(F.struct("start_ms", "style"), "cue_no")
    return runs.groupBy("track_id", "_run", "text").agg(F.min("cue_no").alias("cue_no"), first.alias("_first"), F.max("end_ms").alias("end_ms")).select(
        "track_id", "cue_no", F.col("_first.start_ms").alias("start_ms"), "end_ms", F.col("_first.style").alias("style"), "text"
    )


def op_gap(spans: DataFrame, key: str = "track_id", least: int = 60_000, search: tuple[int, int] = (30_000, 360_000)) -> DataFrame:
    """The largest gap between neighbouring spans that begins within ``search``; the first of equals. Tracks without one are absent."""
    order = Window.partitionBy(key).orderBy("start_ms", "cue_no")
    gaps = spans.withColumn("gap_end", F.lead("start_ms").over(order)).withColumn("gap", F.col("gap_end") - F.col("end_ms"))
    best = Window.partitionBy(key).orderBy(F.desc("gap"), "start_ms", "cue_no")
    return (
        gaps.where((F.col("gap") >= least) & F.col("end_ms").between(*search))
        .withColumn("_r", F.row_number().over(best)).where("_r = 1")
        .select(key, F.col("end_ms").alias("gap_start"), "gap_end")
    )


def coverage_check(cues: DataFrame, tolerance: int = 50) -> DataFrame:
    """Per track: how the dialogue's first start and last end moved against all cues, and whether that was to be expected.

    ``empty`` without dialogue, ``within`` the tolerance, ``expected`` if cues that are no dialogue were dropped, else ``unexpected``.
    """
    dialogue = ~non_dialogue_style(F.col("style"))
    a = cues.groupBy("track_id").agg(
        F.min("start_ms").alias("_s"), F.max("end_ms").alias("_e"), F.min(F.when(dialogue, F.col("start_ms"))).alias("_ds"), F.max(F.when(dialogue, F.col("end_ms"))).alias("_de"),
        F.count_if(~dialogue).alias("n_other"),
    )
    return a.select("track_id", (F.col("_ds") - F.col("_s")).alias("start_diff"), (F.col("_e") - F.col("_de")).alias("end_diff"), "n_other").withColumn(
        "status",
        F.when(F.col("start_diff").isNull(), "empty").when((F.abs("start_diff") <= tolerance) & (F.abs("end_diff") <= tolerance), "within").when(F.col("n_other") > 0, "expected").otherwise("unexpected"),
    )


def track_counters(cues: DataFrame, batch: int = 16) -> DataFrame:
    """Lines, characters and model batches per track."""
    n = F.count(F.lit(1))
    return cues.groupBy("track_id").agg(n.alias("lines"), F.sum(F.length("text")).alias("chars"), F.ceil(n / batch).alias("batches"))


def clock(ms: Column) -> Column:
    """HH:MM:SS,mmm."""
    part = lambda div, mod: F.floor(ms / div) % mod
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def srt_text(cues: DataFrame) -> DataFrame:
    """(track_id, text): each track as numbered blocks in file order; a null text is an empty block."""
    no = F.row_number().over(Window.partitionBy("track_id").orderBy("cue_no"))
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    blocks = cues.withColumn("_n", no).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("cue_no", block.alias("b")))).alias("_b"))
    return blocks.select("track_id", F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("text"))


def analyze_tracks(cues: DataFrame, styles: DataFrame | None = None, compact: bool = False) -> DataFrame:
    """(track_id, event_count, style_count, doc): a JSON document per track of its events that aren't blank.

    It has both counts, per style in order of name the counts, totals, means and shares of its events' features, the ``styles``' definitions
    (track_id, style and any columns), and unless ``compact`` the features of every event in order.
    """
    f = event_features(cues.where(~is_blank(F.col("raw_text"))))
    share = lambda x: (F.sum(x) / F.count(F.lit(1))).cast("decimal(18,3)")
    counted = {"positioned": F.col("has_pos") | F.col("has_move"), "karaoke": F.col("has_karaoke"), "drawing": F.col("is_drawing"), "clip": F.col("has_clip")} | ({"comment": F.col("is_comment")} if "is_comment" in f.columns else {})
    fields = [c for c in f.columns if c not in ("track_id", "cue_no")]
    # The events are read once: they lie with their style's sums, and both are put together by track.
    per_style = f.groupBy("track_id", "style").agg(
        F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_duration_ms"), F.sum("text_length").alias("total_text_length"),
        *[F.count_if(x).alias(f"{name}_count") for name, x in counted.items()], share("duration_ms").alias("avg_duration_ms"), share("text_length").alias("avg_text_length"),
        *[share(counted[name].cast("int")).alias(f"{name}_ratio") for name in ("positioned", "karaoke")], *([] if compact else [F.collect_list(F.struct("cue_no", *fields)).alias("_events")]),
    )
    rows = lambda df, first: F.sort_array(F.collect_list(F.struct(first, *[c for c in df.columns if c not in ("track_id", first, "_events")])))
    events = [] if compact else [F.sort_array(F.flatten(F.collect_list("_events"))).alias("events")]
    made = per_style.groupBy("track_id").agg(rows(per_style, "style").alias("styles"), F.sum("count").alias("event_count"), *events).withColumn("style_count", F.size("styles"))
    parts = ["event_count", "style_count", "styles"]
    if styles is not None:
        made = made.join(styles.groupBy("track_id").agg(rows(styles, "style").alias("style_definitions")), "track_id", "left")
        parts.append("style_definitions")
    if not compact:
        parts.append("events")
    return made.select("track_id", "event_count", "style_count", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("doc"))


def batches(cues: DataFrame, n: int = 16) -> DataFrame:
    """Position of each line in its track and the batch it falls in."""
    pos = F.row_number().over(Window.partitionBy("track_id").orderBy("cue_no")) - 1
    return cues.select("track_id", "cue_no", F.floor(pos / n).alias("batch"))
