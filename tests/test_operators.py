"""Single operators on small inline cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.functions import text as t
from subtide.operators import cues as c, fetch, match as m, runs as r, select as s, training as tg, translate as tr, units as u
from subtide.sources import ass, documents, files as f

CUES = "track_id bigint, cue_no bigint, start_ms bigint, end_ms bigint, style string, raw_text string, text string"


def cue_table(spark, rows):
    return spark.createDataFrame([(1, i, *row) for i, row in enumerate(rows)], CUES)


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


def test_styles(spark):
    rows = [(i * 3000, i * 3000 + 2000, "Main", "Some spoken line", "") for i in range(5)]
    rows += [(i * 3000, i * 3000 + 2000, "Signs", r"{\pos(1,2)}Shop", "") for i in range(5)]
    rows += [(i * 100, i * 100 + 90, "Kara", "ka", "") for i in range(80)]
    rows += [(i * 100, i * 100 + 90, "Rapid", "syllables", "") for i in range(600)]
    rows += [(i * 3000, i * 3000 + 2500, "Alt", r"{\pos(1,2)}A long line placed at the top of it", "") for i in range(5)]
    got = {r["style"]: r["is_dialogue"] for r in c.classify_styles(cue_table(spark, rows)).collect()}
    assert got == {"Main": True, "Signs": False, "Kara": False, "Rapid": False, "Alt": True}


def test_dedup_skips_short_cues_before_runs(spark):
    rows = [(0, 10, "A", "", "hello"), (10, 20, "B", "", "x"), (20, 30, "B", "", " hello "), (30, 35, "C", "", "bye"), (40, 50, "C", "", "hello")]
    got = [tuple(x) for x in c.dedup_cues(cue_table(spark, rows)).orderBy("cue_no").select("start_ms", "end_ms", "style", "text").collect()]
    assert got == [(0, 30, "A", "hello"), (30, 35, "C", "bye"), (40, 50, "C", "hello")]


def test_activity_bins(spark):
    def bins(spans, duration, width):
        df = spark.createDataFrame([(1, a, b, duration) for a, b in spans], "track_id bigint, start_ms bigint, end_ms bigint, duration_ms bigint")
        return sorted(x["bin"] for x in c.activity_bins(df, width).collect())

    assert bins([(0, 2000)], 4000, 2000) == [0]
    assert bins([(0, 2001)], 4000, 2000) == [0, 1]
    assert bins([(500, 500), (3900, 9000)], 5000, 2000) == [0, 1, 2]
    assert bins([(-900, -100)], 5000, 2000) == []


def pair(spark, starts, pair_id=1):
    return spark.createDataFrame([(pair_id, i, x, x + 1500, "t") for i, x in enumerate(starts)], "pair_id bigint, cue_no bigint, start_ms bigint, end_ms bigint, text string")


STARTS = [1000 * k for k in (1, 4, 9, 11, 17, 21, 30, 34, 39, 47, 52, 58, 66, 71, 75, 84)]


def test_offsets(spark):
    for shift in (1500, -2000, 0):
        got = m.estimate_offset(pair(spark, STARTS), pair(spark, [x + 20_000 - 20_000 - shift for x in STARTS if x > 3000])).first()
        assert abs(got["offset_ms"] - shift) <= 100
    assert m.estimate_offset(pair(spark, STARTS), pair(spark, [x * 40 for x in STARTS]), least=0.9).count() == 0


def test_plan_with_opening(spark):
    pre = [5000 + 8000 * k + 700 * (k % 3) for k in range(12)]
    post = [210_000 + 17_000 * k + 900 * (k % 4) for k in range(16)]
    cand = pre + [x - 110_000 for x in post]
    plan = m.align_plan(pair(spark, pre + post), pair(spark, cand)).first()
    assert plan["pre_ms"] == 0 and abs(plan["post_ms"] - 110_000) <= 200 and plan["boundary_ms"] is not None
    score = m.line_match_score(pair(spark, pre + post), m.apply_shift(pair(spark, cand), m.align_plan(pair(spark, pre + post), pair(spark, cand)))).first()["score"]
    assert score == 1.0


def test_units_hold_every_line_once(spark):
    texts = ["I went", "to the shop.", "- Who?", "Yes.", "This is one whole sentence.", "This is another whole sentence.", "And here comes a third one.", "A fourth one follows after it.", "Wait...", "What is it now then?", "and so,", "", "it ends."]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "track_id bigint, cue_no bigint, text string")
    units = u.group_units(lines)
    got = [(x["cue_nos"], x["is_fragment_merge"]) for x in units.orderBy("unit_no").collect()]
    assert got == [([0, 1], True), ([2], False), ([3], False), ([4, 5, 6], False), ([7], False), ([8], True), ([9], False), ([10, 11, 12], True)]
    joined = u.build_input(lines, units)
    assert joined.where("unit_no = 3").first()["input"] == " || ".join(texts[4:7])
    back = {x["cue_no"]: x["text"] for x in u.split_output(lines, units, joined.withColumnRenamed("input", "output")).collect()}
    assert back[4] == texts[4] and back[0] == "I went" and back[1] == "to the shop." and sorted(back) == list(range(13))


def test_text_rules(spark):
    assert one(spark, t.fix_translation, "- Nie! - Nie!") == "Nie!"
    assert one(spark, t.fix_translation, "Tak, tak!") == "Tak!"
    assert one(spark, t.fix_translation, " Co  ?!! ") == "Co?!"
    assert one(spark, t.replace_polish, "Zażółć gęślą jaźń") == "Zazolc gesla jazn"
    assert one(spark, t.is_sentence_end, 'He said "no."') is True and one(spark, t.is_sentence_end, "Wait...") is False
    looked = t.phrase_lookup(spark.createDataFrame([(1, "THANK YOU!"), (2, "Hey, you"), (3, "It was a piece of cake.")], "cue_no int, text string")).orderBy("cue_no").collect()
    assert [(x["translation"], x["answered"]) for x in looked] == [("DZIĘKUJĘ!", True), ("Hey, you", False), ("It was a very easy.", False)]


def test_protecting_and_restoring():
    text, tags = tr.protect_one("Guts met Guts at 12:30, see http://a.b/c or call 555-123-4567, John Smith", ["Guts"])
    assert "Guts" not in text and "12:30" not in text and "John" not in text
    for tag, what in tags.items():
        text = text.replace(tag, what)
    assert text == "Guts met Guts at 12:30, see http://a.b/c or call 555-123-4567, John Smith"


def test_translation_falls_back_without_tags(spark):
    lines = spark.createDataFrame([(1, 0, "Hello Guts, where were you?"), (1, 1, "Yes!"), (1, 2, "   "), (1, 3, "Guts!")], "track_id bigint, cue_no bigint, text string")
    got = {x["cue_no"]: x["translation"] for x in tr.translate_lines(lines, lambda texts: ["" for _ in texts], ["Guts"]).collect()}
    assert got == {0: "Hello Guts, where were you?", 1: "Tak!", 2: "   ", 3: "Guts!"}


def test_contended_runs_are_matched_in_order(spark):
    schema = "no bigint, hash string, media_type string, title string, season int, episode int, stages array<string>"
    row = lambda no, h, title, st=("a",): (no, h, "episode", title, 1, 1, list(st))
    before = spark.createDataFrame([row(0, "x", "A"), row(1, "x", "B"), row(2, None, "A"), row(3, "z", "C", ("q",)), row(4, None, None), row(5, "", "C")], schema)
    after = spark.createDataFrame([row(10, "y", "A"), row(11, "x", "B"), row(12, "w", "C")], schema)
    got = sorted(tuple(x) for x in r.match_runs(before, after).collect())
    assert got == [(0, 11, "hash", False), (2, 10, "identity", False), (3, 12, "identity", True), (5, 12, "identity", False)]


def test_entries_and_stems(spark):
    rows = [("Show ep12", 1, 12, True), ("Show ep10-13", 1, 12, True), ("Show S2 ep12", 1, 12, False), ("Show S2 ep12", 2, 12, True), ("Show OVA ep12", 1, 12, False), ("Other ep12", 1, 12, False), ("Show ep1", 1, 12, False)]
    rows += [("Show episode 12", 1, 12, True), ("Show S2 Arc ep3", 2, 3, True), ("Show S2 ep3", None, 3, True), ("Show OVA ep3", None, 3, True), ("Show Movie", 1, 1, False), ("Show ep01-10", 1, 11, False), ("Show 3: Bonus Stage ep1", 3, 1, False), ("SHOW 2 ep08", 2, 8, True), ("", 1, 1, False)]
    df = spark.createDataFrame(rows, "title string, season int, episode int, want boolean")
    assert all(x["want"] == x["got"] for x in df.withColumn("got", s.entry_matches(F.col("title"), F.lit("Show"), F.col("season"), F.col("episode"))).collect())
    assert spark.range(1).select(s.output_stem(F.lit("A: b!"), F.lit(1), F.lit(2)).alias("x")).first()["x"] == "A b - S01E02"


def test_fonts(spark):
    styles = spark.createDataFrame([(1, "My-Font"), (1, "Nowhere")], "media_id bigint, fontname string")
    fonts = spark.createDataFrame([("My Font Bold", list("ąć")), ("Aardvark", list("ąć")), ("Arial", list("ąć")), ("Noto-Sans", list("ą")), ("Times_New_Roman", list("ąć"))], "stem string, letters array<string>")
    assert {(x["fontname"], x["stem"]) for x in s.pick_font(styles, fonts, "ąć").collect()} == {("My-Font", "My Font Bold"), ("Nowhere", "Arial")}
    assert [x["stem"] for x in s.pick_font(styles, fonts.where("stem < 'Aq'"), "ąć").collect()] == ["Aardvark", "Aardvark"]
    assert s.pick_font(styles, fonts.limit(0), "ąć").count() == 0
    assert {tuple(x) for x in s.embedded_font_covers(spark.createDataFrame([(1, list("ąć")), (1, ["ą"]), (2, ["ą"]), (3, None)], "media_id bigint, letters array<string>"), "ąć").collect()} == {(1, True), (2, False), (3, False)}


def test_files(spark, tmp_path):
    srt = "1\n00:00:01,000 --> 00:00:03,500\nHello\nthere\n\n2\n00:01:04,000 --> 00:01:06,000\nBye\n"
    (tmp_path / "a.srt").write_text(srt)
    got = [tuple(x)[1:] for x in f.parse_srt(f.read_whole(spark, str(tmp_path / "a.srt"))).orderBy("cue_no").collect()]
    assert got == [(1, 1000, 3500, "Hello\nthere"), (2, 64000, 66000, "Bye")]
    made = "[V4+ Styles]\nFormat: Name, Fontname, Fontsize, Bold, Italic, Alignment\nStyle: Default,Arial,40,0,0,2\n\n[Events]\nDialogue: 0,0:00:01.00,0:00:03.50,Default,,0,0,0,,{\\pos(1,2)}Hi, all\\Nhere\nComment: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,note\n"
    df = spark.createDataFrame([(1, made)], "track_id bigint, text string")
    got = [(x["start_ms"], x["end_ms"], x["text"], x["is_comment"]) for x in ass.ass_events(ass.ass_lines(df)).orderBy("cue_no").collect()]
    assert got == [(1000, 3500, "Hi, all\nhere", False), (5000, 6000, "note", True)]
    assert ass.style_definitions(ass.ass_styles(ass.ass_lines(df))).first()["fontname"] == "Arial"
    for name in ("a.mkv", "b.MP4", "c.txt", ".d.mkv"):
        (tmp_path / "v").mkdir(exist_ok=True)
        (tmp_path / "v" / name).write_bytes(b"x" * 10)
    found = f.discover_media(spark, str(tmp_path / "v"))
    assert sorted(x["path"].rsplit("/", 1)[1] for x in found.collect()) == ["a.mkv", "b.MP4"]
    assert f.fingerprint_media(found).first()["oshash"] == f.oshash(10, b"x" * 10, b"x" * 10)
    raw = spark.createDataFrame([(bytearray("zażółć".encode(enc)),) for enc in ("utf-8", "cp1250", "iso-8859-2")], "b binary")
    assert {bytes(x["y"]).decode() for x in raw.select(f.normalize_encoding("b").alias("y")).collect()} == {"zażółć"}


def test_responses(spark):
    html = '<table class="Napisy"><tr><td width="45%"> Show ep1 </td><td width="20%">Advanced SSA</td><td><input type="hidden" name="id" value="7"><input type="hidden" name="sh" value="q"></td></tr></table><table class="Napisy"><td width="45%">no id</td></table>'
    got = f.candidates_from_html(spark.createDataFrame([(1, html)], "media_id bigint, body string")).collect()
    assert [tuple(x) for x in got] == [(1, "animesub", "7", "q", "Show ep1", "ass")]
    body = '{"data":[{"id":"1","attributes":{"language":"pl","release":"R","moviehash_match":true,"files":[{"file_id":5,"file_name":"x.SRT"}]}},{"id":"2","attributes":{"language":"xx","files":[{"file_id":6,"file_name":"y"}]}},{"id":"3","attributes":{"language":"en","files":[]}}]}'
    got = f.candidates_from_json(spark.createDataFrame([(1, "r", body), (2, None, None), (3, None, "{")], "media_id bigint, raw_filename string, body string")).collect()
    assert [tuple(x) for x in got] == [(1, "opensubtitles", "5", "pol", "R", "SRT", 1.0, True)]
    xml = "<r><subtitle><id>a</id><language>pl</language><release>X</release></subtitle><subtitle><id>b</id><language>en</language><release>Y</release></subtitle></r>"
    part = "<r><subtitle><id>c</id><language>pl</language></subtitle><subtitle><id>d</id><language>fr</language><release>Z</release></subtitle></r>"
    got = f.candidates_from_xml(spark.createDataFrame([(1, True, xml), (2, None, part), (3, None, "<r><subtitle>"), (4, None, None)], "media_id bigint, hash_match boolean, body string")).collect()
    assert sorted((x["subtitle_id"], x["language"], x["release_name"], x["score"]) for x in got) == [("a", "pol", "X", 0.9), ("b", "eng", "Y", 0.9), ("c", "pol", "", 0.65)]


def test_null_lines_keep_their_place(spark):
    cues = spark.createDataFrame([(1, 1, 0, 10, "a"), (1, 2, 20, 30, None), (1, 3, 40, 50, "b ||| c")], "track_id bigint, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    assert c.srt_text(cues).first()["text"].count(" --> ") == 3
    assert [(x["context"], x["own"]) for x in u.context_window(cues, 1).orderBy("cue_no").collect()] == [("a ||| ", "a"), ("a |||  ||| b ||| c", ""), (" ||| b ||| c", "b ||| c")]


def test_reports(spark, tmp_path):
    videos = spark.createDataFrame([("p", "h", ("episode", "T", 1, 2), 5.0, [("a.b", 1.5, None)])], "path string, hash string, identity struct<media_type:string,title:string,season:int,episode:int>, total_duration_ms double, entries array<struct<name:string,duration_ms:double,details:string>>")
    documents.write_report(videos.withColumn("video_no", F.lit(0)), str(tmp_path / "r"), "abc", True, {"k": "v"})
    back = f.read_reports(spark, str(tmp_path / "r")).first()
    assert (back["version"], back["git_commit"], back["dirty"], back["config"]) == (1, "abc", True, {"k": "v"}) and back["videos"][0]["entries"][0]["name"] == "a.b"


def test_pages_probe(spark):
    probe = '{"streams":[{"index":0,"codec_type":"video","r_frame_rate":"24000/1001"},{"index":2,"codec_type":"subtitle","codec_name":"ass","tags":{"language":"eng","title":"Full"}},{"index":3,"codec_type":"attachment","tags":{"filename":"a.ttf","mimetype":"x"}}],"format":{"tags":{"title":"T"}}}'
    df = spark.createDataFrame([(1, probe)], "media_id bigint, probe string")
    assert tuple(s.explode_streams(df).first())[1:] == (2, 0, "ass", "eng", "Full")
    facts = s.probe_facts(df).first()
    assert facts["title"] == "T" and abs(facts["fps"] - 23.976) < 0.001 and facts["fonts"] == ["a.ttf"]


def test_fetch_keeps_the_best_and_good_others(spark):
    kind = "media_id bigint, source string, subtitle_id string, language string, score double, hash_match boolean, pair_id string"
    rows = [(1, "a", "1", "pol", 0.6, False, "p1"), (1, "a", "2", "pol", 0.7, False, "p2"), (1, "b", "3", "pol", 0.7, True, "p3"), (1, "b", "4", "eng", 0.7, True, "p4"), (2, "a", "5", "pol", 0.6, False, "p5"), (2, "a", "6", "pol", 0.9, False, "p6")]
    found = spark.createDataFrame(rows, kind)
    scores = spark.createDataFrame([("p1", 0.9), ("p2", 0.8), ("p3", 0.7), ("p4", 0.4)], "pair_id string, score double")
    media = spark.createDataFrame([(1,)], "media_id bigint")
    got = lambda f, s, m: sorted((r["pair_id"], r["place"], r["match_score"]) for r in fetch.keep_valid(f, s, m).collect())
    assert got(found, scores, media) == [("p1", 1, 0.9), ("p2", 2, 0.8), ("p6", 1, None)]
    assert got(found.limit(0), scores, media) == []
    assert got(found, scores.limit(0), media.limit(0)) == [("p3", 1, None), ("p4", 1, None), ("p6", 1, None)]


def test_match_runs_settles_chains_in_order(spark):
    kind = "no bigint, hash string, media_type string, title string, season int, episode int, stages array<string>"
    before = [(1, "h", "tv", "a", 1, 1, ["x"]), (2, "h", "tv", "b", 1, 2, ["x"]), (3, "h", "tv", "b", 1, 2, ["x"]), (4, None, "tv", "c", 1, 3, None), (5, "k", None, None, None, None, ["y"]), (6, "k", None, None, None, None, ["x"])]
    after = [(10, "h", "tv", "a", 1, 1, ["x"]), (11, None, "tv", "b", 1, 2, ["x"]), (12, None, "tv", "c", 1, 3, ["x"]), (13, "k", None, None, None, None, ["x"])]
    got = r.match_runs(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 10, "hash", False), (2, 11, "identity", False), (4, 12, "identity", False), (5, 13, "hash", True), (6, 13, "hash", False)]


def test_calibration_copies_no_cue(spark):
    """Tracks meet as densities: rows that reach a join of pairs are as many as tracks, and a start past a pair's end counts in its last window."""
    cues = lambda key, starts, length=500: spark.createDataFrame([(key, i, x, x + length) for i, x in enumerate(starts)], "pair_id long, cue_no long, start_ms long, end_ms long")
    ref = cues(0, [0, 100, 1200, 3300]).union(cues(1, [900, 1000, 2200, 5000], -4000))  # ends lie before starts
    cand = cues(0, [1000, 1100, 2200, 4300]).union(cues(1, [0, 10, 1200, 3300]))
    got = {(r.kind, r.ref_id, r.cand_id): r.score for r in m.calibration_scores(ref, cand, [1000]).collect()}
    assert got["OWN", 0, 0] == pytest.approx(1.0)  # the same, a window later

    def plain(r, c, n):
        best = 0.0
        for k in (-1, 0, 1):
            x, y = zip(*[(r[b], c[b - k]) for b in range(n) if 0 <= b - k < n])
            if len(x) >= 3 and len(set(x)) > 1 and len(set(y)) > 1:
                best = max(best, float(np.corrcoef(x, y)[0, 1]))
        return best

    assert got["OWN", 1, 1] == pytest.approx(plain([1, 1, 1, 1], [2, 1, 0, 1], 4)) == 0.0
    assert got["CROSS", 1, 0] == pytest.approx(plain([1, 1, 1, 0, 1], [0, 2, 1, 0, 1], 5))
    plan = m.calibration_scores(ref, cand, [1000])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("start_ms" in line for line in joins)
    assert len(joins) <= 3


def test_alignment_shuffles_cues_once(spark):
    """The plan and both scores are made where one shuffle by pair has put the cues."""
    cues = lambda starts: spark.createDataFrame([(1, i, x, x + 900, "a") for i, x in enumerate(starts)], "pair_id long, cue_no long, start_ms long, end_ms long, text string")
    best = m.best_candidates(cues(STARTS), cues([x + 3000 for x in STARTS]))
    executed = [line for line in best._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert executed and all("REPARTITION_BY_NUM" in line for line in executed)
    row = best.first()
    assert row.post_ms == -3000 and row.score_after == 1.0 > row.score_before


def test_rules_are_written_once(spark):
    """No rule's expression holds another's result twice: work would double with every step. Labels use no lambdas, which would keep Spark from sharing what they have in common."""
    assert str(t.fix_translation(F.col("x"))).count("regexp_replace") <= 11
    assert "lambda" not in str(t.qa_issues(F.col("x"))).lower()


def test_fetch_reads_equal_files_once(spark):
    """Files of one content are read and aligned once; the English one of them stays where it is, a null content has no cues."""
    srt = c.srt_text(cue_table(spark, [(x + 3000, x + 3900, "s", "a", "a") for x in STARTS])).first()["text"].encode()
    kind = "media_id bigint, source string, subtitle_id string"
    files = spark.createDataFrame([(1, "a", "1", srt), (1, "b", "1", srt), (1, "b", "2", srt), (2, "a", "3", srt), (2, "a", "4", None)], f"{kind}, content binary")
    once = fetch.distinct_files(files).collect()
    assert sorted((x["media_id"], x["content"] is None, sorted(map(tuple, x["names"]))) for x in once) == [(1, False, [("a", "1"), ("b", "1"), ("b", "2")]), (2, False, [("a", "3")]), (2, True, [("a", "4")])]
    found = spark.createDataFrame([(1, "a", "1", "pol", 0.6, False), (1, "b", "1", "pol", 0.9, True), (1, "b", "2", "eng", 0.9, True), (2, "a", "4", "pol", 0.9, True)], f"{kind}, language string, score double, hash_match boolean")
    refs = spark.createDataFrame([(1, i, x, x + 900) for i, x in enumerate(x - 1500 for x in STARTS)], "media_id bigint, cue_no bigint, start_ms bigint, end_ms bigint")
    refs = refs.withColumns({x: F.col(x) + 3000 for x in ("start_ms", "end_ms")})  # the files are 1.5 s late
    got = sorted((x["media_id"], x["source"], x["subtitle_id"], x["place"], x["post_ms"], x["n_cues"], x["first_ms"]) for x in fetch.fetch_subtitles(found, files, refs).collect())
    n, first = len(STARTS), min(STARTS) + 3000
    assert got == [(1, "a", "1", 2, -1500, n, first - 1500), (1, "b", "1", 1, -1500, n, first - 1500), (1, "b", "2", 1, None, n, first), (2, "a", "4", 1, None, None, None)]


def test_units_shuffle_lines_once(spark):
    lines = spark.range(40).selectExpr("id DIV 10 AS track_id", "id AS cue_no", "'some words to say.' AS text")
    whole = u.inputs_of(u.whole_units(lines)).withColumnRenamed("input", "output")
    for df in (u.group_units(lines), whole, u.dealt(whole)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_batches_of_long_lines_keep_to_both_caps(spark):
    sizes = [(i * i * 7 + i) % 31 + 4 for i in range(200)] + [70, 5, 5, 5, 5, 61, 59, 4, 20, 20, 20, 21]
    lines = spark.createDataFrame([(t, i, " ".join(["\twürd"] * n) + ".") for t, some in ((1, sizes), (2, [7] * 11)) for i, n in enumerate(some)], "track_id bigint, cue_no bigint, text string")
    for track, some in ((1, sizes), (2, [7] * 11)):
        want = []
        for i, n in enumerate(some):
            if want and len(want[-1]) < 3 and sum(some[k] for k in want[-1]) + n <= 60:
                want[-1].append(i)
            else:
                want.append([i])
        assert [x["cue_nos"] for x in u.group_units(lines).where(f"track_id = {track}").orderBy("unit_no").collect()] == want
    back = u.dealt(u.inputs_of(u.whole_units(lines)).withColumnRenamed("input", "output"))
    joined = u.split_output(lines, u.group_units(lines), u.build_input(lines, u.group_units(lines)).withColumnRenamed("input", "output"))
    assert back.exceptAll(joined).isEmpty() and back.count() == joined.count() == len(sizes) + 11


def test_pair_issues_are_written_without_lambdas(spark):
    made = tg.pair_issues(F.col("e"), F.col("p"), ["Guts", "there"])
    assert "lambda" not in str(made).lower()
    rows = [("Guts went home", "Guts went DOMU"), ("Is there any", "Czy TAM any"), ("abcd1 ąabcd there", "ABCD1 ĄABCD THERE"), ("x", "xxxx"), (None, "abcd"), ("abcd", None), ("", "")]
    got = [x.i for x in spark.createDataFrame(rows, "e string, p string").select(made.alias("i")).collect()]
    assert got == [["untranslated"], ["name"], [], ["length"], [], [], []]
