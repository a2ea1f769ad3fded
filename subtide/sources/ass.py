"""ASS files as tables of lines that keep every field, and back.

A line belongs to a section; lines of a section with a Format line have its names and their own values in order. So whatever
fields a file has are read, can be set by name, and are written as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.operators.cues import plain_text

# Names of dialogue styles, tried in this order.
DIALOGUE_STYLES = ("Default", "Dialogue", "Dialog", "Main", "Dialogi", "Normal")

#: What a track without a header gets, and the format of written events.
DEFAULT_HEAD = (
    "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Alignment, MarginL, MarginR, MarginV\nStyle: Default,Arial,20,&H00FFFFFF,0,0,2,10,10,10"
)
EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"

_STYLES = r"^V4\+{0,2} Styles$"


def ass_lines(files: DataFrame) -> DataFrame:
    """(track_id, section_no, line_no, section, prefix, names, values) of the lines of ASS texts (track_id, text); blank lines are left out.

    ``prefix`` is what stands before the values (``Style: ``), ``names`` the section's Format, and ``prefix`` with the values joined by commas is
    the line again. Events without a Format have EVENT_FORMAT's names. Other lines are one value without names. What stands before the first section is section 0, named ''.
    """
    text = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\r\n?", "\n")
    parts = files.select("track_id", F.posexplode(F.split(text, r"(?m)^(?=\[[^\]\n]*\][ \t]*$)")).alias("section_no", "_part"))
    section = F.regexp_extract("_part", r"^\[([^\]\n]*)\]", 1)
    names = F.coalesce(F.nullif(F.regexp_extract("_part", r"(?m)^Format:[ \t]*(.*)$", 1), F.lit("")), F.when(section == "Events", EVENT_FORMAT.removeprefix("Format: ")))
    # What is a section's is made before its lines are rows, else each line would look through the whole section.
    sections = parts.select("track_id", "section_no", section.alias("section"), F.transform(F.split(names, ","), lambda n: F.trim(n)).alias("_names"), F.split("_part", "\n").alias("_lines"))
    named = sections.select("track_id", "section_no", "section", "_names", F.posexplode("_lines").alias("line_no", "_line")).where(F.trim("_line") != "")
    prefix = F.regexp_extract("_line", r"^(?!Format:)[A-Za-z]+:[ \t]*", 0)
    fielded = F.col("_names").isNotNull() & (prefix != "")
    values = F.call_function("split", F.substring(F.col("_line"), F.length("_prefix") + 1, F.length("_line")), F.lit(","), F.size("_names"))
    return named.withColumn("_prefix", F.when(fielded, prefix).otherwise("")).select(
        "track_id", "section_no", "line_no", "section", F.col("_prefix").alias("prefix"), F.when(F.col("_prefix") != "", F.col("_names")).alias("names"),
        F.when(F.col("_prefix") != "", values).otherwise(F.array("_line")).alias("values"),
    )


def field(name: str) -> Column:
    """The line's value of that name; null if it has none."""
    return F.get("values", (F.array_position("names", name) - 1).cast("int"))


def with_field(name: str, value: Column) -> Column:
    """The line's values with ``value`` in the place of that name."""
    return F.transform("values", lambda v, i: F.when(F.get("names", i) == name, value.cast("string")).otherwise(v))


def line_text() -> Column:
    return F.concat("prefix", F.array_join("values", ",", null_replacement=""))


def ass_text_of(lines: DataFrame) -> DataFrame:
    """(track_id, text): the texts of ``lines``, a blank line before each section but the first, line ends as ``\\n``."""
    first = (F.col("line_no") == 0) & (F.col("section") != "") & (F.col("section_no") > 0)
    made = lines.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "line_no", F.concat(F.when(first, "\n").otherwise(""), line_text()).alias("l")))).alias("_l"))
    return made.select("track_id", F.concat(F.array_join("_l.l", "\n"), F.lit("\n")).alias("text"))


def ass_styles(lines: DataFrame) -> DataFrame:
    """(track_id, style_no, style, names, values, prefix): the styles of each track in order, with every field."""
    rows = lines.where(F.col("section").rlike(_STYLES) & F.col("prefix").startswith("Style:"))
    no = F.row_number().over(Window.partitionBy("track_id").orderBy("section_no", "line_no"))
    return rows.select("track_id", no.alias("style_no"), F.trim(field("Name")).alias("style"), "names", "values", "prefix")


def style_definitions(styles: DataFrame) -> DataFrame:
    """(track_id, style, fontname, fontsize, alignment, bold, italic, margin_l, margin_r, margin_v); what a style doesn't say is null."""
    number = lambda name, kind: F.trim(field(name)).try_cast(kind)
    flag = lambda name: F.trim(field(name)).isin("-1", "1")
    return styles.select(
        "track_id", "style", F.trim(field("Fontname")).alias("fontname"), number("Fontsize", "double").alias("fontsize"), number("Alignment", "int").alias("alignment"),
        flag("Bold").alias("bold"), flag("Italic").alias("italic"), *[number(f"Margin{x.upper()}", "int").alias(f"margin_{x}") for x in "lrv"],
    )


def _ms(x: Column) -> Column:
    found = F.split(F.coalesce(F.regexp_substr(x, F.lit(r"\d+:\d{1,2}:\d{1,2}\.\d{2}")), F.substring(x, 1, 0)), "[:.]")
    p = [F.get(found, F.lit(k)).cast("long") for k in range(4)]
    return ((p[0] * 60 + p[1]) * 60 + p[2]) * 1000 + p[3] * 10


def ass_events(lines: DataFrame) -> DataFrame:
    """The events of each track in order as cues: every field of a Format, whatever its order, with times in milliseconds."""
    rows = lines.where((F.col("section") == "Events") & F.col("prefix").rlike("^(Dialogue|Comment):"))
    no = F.row_number().over(Window.partitionBy("track_id").orderBy("section_no", "line_no"))
    whole = lambda name: F.coalesce(F.trim(field(name)).try_cast("int"), F.lit(0))
    return rows.select(
        "track_id", no.cast("long").alias("cue_no"), whole("Layer").alias("layer"), _ms(field("Start")).alias("start_ms"), _ms(field("End")).alias("end_ms"), F.trim(field("Style")).alias("style"),
        F.coalesce(field("Name"), F.lit("")).alias("name"), *[whole(f"Margin{x.upper()}").alias(f"margin_{x}") for x in "lrv"], F.coalesce(field("Effect"), F.lit("")).alias("effect"),
        F.col("prefix").startswith("Comment").alias("is_comment"), field("Text").alias("raw_text"), plain_text(field("Text")).alias("text"),
    )


def pick_dialogue_style(styles: DataFrame) -> DataFrame:
    """(track_id, style): the first of DIALOGUE_STYLES that the track has, else the first whose name holds dialog, default or main, else its first."""
    at = F.array_position(F.array(*[F.lit(s) for s in DIALOGUE_STYLES]), F.col("style"))
    rank = F.when(at > 0, at).when(F.lower("style").rlike("dialog|default|main"), 100).otherwise(101)
    return styles.groupBy("track_id").agg(F.min_by("style", F.struct(rank, F.col("style_no"))).alias("style"))


def ass_clock(ms: Column) -> Column:
    """H:MM:SS.cc."""
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100)


def write_ass(lines: DataFrame, cues: DataFrame, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """(track_id, text): the cues (track_id, cue_no, start_ms, end_ms, text) under the script info and styles of their track's original.

    Every style stays as it was with all its fields; every cue has the original's dialogue style. ``transform`` is applied to
    the text; its line breaks are written as ``\\N``. Null is an empty text. A track whose original isn't there, or has no
    styles, gets DEFAULT_HEAD. Tracks without cues aren't written.
    """
    kept = lines.where((F.col("section") == "Script Info") | F.col("section").rlike(_STYLES))
    first = (F.col("line_no") == 0) & F.col("section").rlike(_STYLES)
    head = kept.select("track_id", F.struct("section_no", F.col("line_no").cast("long").alias("line_no"), F.concat(F.when(first, "\n").otherwise(""), line_text()).alias("l")).alias("_h"), F.lit(None).alias("_e"))
    body = F.replace(F.coalesce(F.col("text") if transform is None else transform(F.col("text")), F.lit("")), F.lit("\n"), F.lit(r"\N"))
    picked = cues.select("track_id", "cue_no", "start_ms", "end_ms", body.alias("_t")).join(pick_dialogue_style(ass_styles(lines)), "track_id", "left")
    line = F.concat(F.lit("Dialogue: 0,"), ass_clock(F.col("start_ms")), F.lit(","), ass_clock(F.col("end_ms")), F.lit(","), F.coalesce("style", F.lit("Default")), F.lit(",,0,0,0,,"), "_t")
    events = picked.select("track_id", F.lit(None).alias("_h"), F.struct("cue_no", line.alias("l"), F.col("style").isNotNull().alias("styled")).alias("_e"))
    made = head.union(events).groupBy("track_id").agg(F.array_sort(F.collect_list("_h")).alias("_h"), F.array_sort(F.collect_list("_e")).alias("_e")).where(F.size("_e") > 0)
    top = F.when(F.get("_e.styled", F.lit(0)), F.array_join("_h.l", "\n")).otherwise(DEFAULT_HEAD)
    return made.select("track_id", F.concat(top, F.lit(f"\n\n[Events]\n{EVENT_FORMAT}\n"), F.array_join("_e.l", "\n"), F.lit("\n")).alias("text"))
