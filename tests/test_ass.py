"""ASS files read, edited and written without a loss."""

import pytest
from pyspark.sql import functions as F

from subtide.operators import cues as c
from subtide.sources import ass

FILE = """; a note before
[Script Info]
; made by hand
Title: One: two, three
ScriptType: v4.00+
PlayResX: 1920

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, Bold, Italic, Spacing, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Main Dialogue,Open Sans Semibold,52,&H00FFFFFF,-1,0,0.5,2,120,120,45,1
Style: Signs,Impact, 30 ,&H000000FF,0,-1,0,8,10,10,10,1

[Fonts]
fontname: x.ttf

[Events]
Format: Marked, Start, Style, End, Effect, Text
Dialogue: Marked=0,0:00:01.00,Signs,0:00:03.50,fx,{\\pos(1,2)}Hi, all\\Nhere
Comment: Marked=0,1:00:05.00,Main Dialogue,1:00:06.00,,note
"""


@pytest.fixture()
def lines(spark):
    rows = [(1, FILE), (2, "﻿" + FILE.replace("\n", "\r\n")), (3, None), (4, ""), (5, "no sections\nat all")]
    return ass.ass_lines(spark.createDataFrame(rows, "track_id bigint, text string"))


def test_reading_and_writing_keeps_all(lines):
    got = {r["track_id"]: r["text"] for r in ass.ass_text_of(lines).collect()}
    tidy = lambda t: [line for line in t.split("\n") if line]
    assert tidy(got[1]) == tidy(FILE) == tidy(got[2]) and got[5] == "no sections\nat all\n" and 3 not in got
    again = ass.ass_lines(ass.ass_text_of(lines))
    key = lambda df: sorted(map(tuple, df.select("track_id", "section", "prefix", "names", "values").collect()), key=repr)
    assert key(again) == key(lines)
    assert key(ass.ass_styles(again).withColumn("section", F.lit(""))) == key(ass.ass_styles(lines).withColumn("section", F.lit("")))


def test_fields_by_the_names_of_the_format(lines):
    styles = [tuple(r)[1:] for r in ass.style_definitions(ass.ass_styles(lines)).where("track_id = 1").orderBy(F.desc("fontsize")).collect()]
    assert styles == [("Main Dialogue", "Open Sans Semibold", 52.0, 2, True, False, 120, 120, 45), ("Signs", "Impact", 30.0, 8, False, True, 10, 10, 10)]
    events = ass.ass_events(lines).where("track_id = 2").orderBy("cue_no").collect()
    assert [(e["start_ms"], e["end_ms"], e["style"], e["effect"], e["is_comment"], e["text"], e["layer"]) for e in events] == [
        (1000, 3500, "Signs", "fx", False, "Hi, all\nhere", 0), (3_605_000, 3_606_000, "Main Dialogue", "", True, "note", 0),
    ]


def test_a_field_is_set_by_name(lines):
    big = lines.withColumn("values", F.when(F.col("prefix").startswith("Style:"), ass.with_field("Fontsize", F.trim(ass.field("Fontsize")).cast("int") * 2)).otherwise(F.col("values")))
    text = ass.ass_text_of(big).where("track_id = 1").first()["text"]
    assert "Style: Main Dialogue,Open Sans Semibold,104,&H00FFFFFF,-1,0,0.5,2,120,120,45,1\n" in text and "Style: Signs,Impact,60,&H000000FF" in text


def test_written_cues_keep_the_styles(spark, lines):
    cues = spark.createDataFrame([(1, 2, 61_230, 62_000, "a\nb"), (1, 1, 0, 10, None), (9, 1, 5, 3_600_000, "alone"), (5, 1, 0, 1000, "x")], "track_id bigint, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    got = {r["track_id"]: r["text"] for r in ass.write_ass(lines, cues, F.upper).collect()}
    assert set(got) == {1, 5, 9}
    head = FILE[FILE.index("[Script") : FILE.index("\n[Fonts]")]
    assert got[1] == head + f"\n[Events]\n{ass.EVENT_FORMAT}\nDialogue: 0,0:00:00.00,0:00:00.01,Main Dialogue,,0,0,0,,\nDialogue: 0,0:01:01.23,0:01:02.00,Main Dialogue,,0,0,0,,A\\NB\n"
    assert got[9] == got[5].replace("0:00:00.00,0:00:01.00", "0:00:00.00,1:00:00.00").replace(",,X", ",,ALONE")
    assert "Style: Default,Arial" in got[9]
    back = ass.ass_styles(ass.ass_lines(spark.createDataFrame(list(got.items()), "track_id bigint, text string"))).where("track_id = 1")
    assert back.select("values").collect() == ass.ass_styles(lines).where("track_id = 1").select("values").collect()


def test_track_documents(spark, lines):
    import json

    events, styles = ass.ass_events(lines), ass.style_definitions(ass.ass_styles(lines))
    doc = json.loads(c.analyze_tracks(events, styles).where("track_id = 1").first()["doc"])
    assert doc["event_count"] == 2 and [s["style"] for s in doc["styles"]] == ["Main Dialogue", "Signs"] and doc["styles"][0]["comment_count"] == 1
    assert doc["styles"][1]["positioned_ratio"] == 1.0 and doc["style_definitions"][1]["fontname"] == "Impact"
    assert [(e["cue_no"], e["has_pos"], e["preview"], e["effect"]) for e in doc["events"]] == [(1, True, "Hi, all\nhere", "fx"), (2, False, "note", "")]
    assert "events" not in json.loads(c.analyze_tracks(events, styles, compact=True).first()["doc"])


def test_a_section_is_looked_through_once(spark):
    """No line carries its section's text or looks for its Format again, and an analysis reads the events once."""
    plan = ass.ass_lines(spark.createDataFrame([(1, FILE)], "track_id bigint, text string"))._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Generate posexplode(_lines")]
    assert "_part" not in top and "Format:[" not in top
    cues = spark.range(9).selectExpr("id DIV 5 AS track_id", "id AS cue_no", "id AS start_ms", "id + 5 AS end_ms", "CAST(id % 2 AS STRING) AS style", "'x' AS raw_text")
    assert c.analyze_tracks(cues)._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
