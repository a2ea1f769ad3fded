"""Search services, saved responses, and documents written by many tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from subtide.operators import runs as r, select as s
from subtide.plans import registry
from subtide.sources import documents, files as f, responses


def service():
    """A class of a function goes to the workers by value."""

    class Library:
        name = "library"

        def search(self, media, languages):
            return [{"subtitle_id": f"{media['title']}-{lang}", "language": lang, "release_name": media["title"], "format": "srt", "score": 0.5, "hash_match": False} for lang in languages if media["title"]]

        def download(self, candidate):
            if candidate["language"] == "pol":
                raise OSError("gone")
            return candidate["subtitle_id"].encode() if candidate["media_id"] != 3 else None

    return Library


def test_a_service_is_searched_and_its_files_fetched(spark):
    media = spark.createDataFrame([(1, "A"), (2, None), (3, "C")], "media_id bigint, title string")
    found = responses.search_media(media, service(), ["eng", "pol"])
    assert found.schema.simpleString() == spark.createDataFrame([], responses.CANDIDATE).schema.simpleString()
    assert sorted((x["media_id"], x["subtitle_id"]) for x in found.collect()) == [(1, "A-eng"), (1, "A-pol"), (3, "C-eng"), (3, "C-pol")]
    assert [tuple(x) for x in responses.download_candidates(found, service()).collect()] == [(1, "library", "A-eng", b"A-eng")]


def test_saved_responses_by_file(spark, tmp_path):
    rows = [(1, "podnapisi", None, True, "<r><subtitle><id>7</id><language>pl</language></subtitle></r>"), (2, "other", None, None, "x"), (3, "podnapisi", None, None, None), (4, "opensubtitles", "é", None, '{"data":[]}')]
    path = str(tmp_path / "saved")
    responses.save_responses(spark.createDataFrame(rows, responses.RESPONSE).repartition(3), path)
    read = responses.read_responses(spark, path)
    assert sorted(map(tuple, read.collect())) == rows and read.rdd.getNumPartitions() == len([x for x in os.listdir(path) if x.endswith(".json")])
    assert [tuple(x) for x in responses.candidates_of(read).collect()] == [(1, "podnapisi", "7", "pol", "", "srt", 0.9, True)]


def test_a_document_of_many_parts(spark, tmp_path):
    df = spark.range(5000).select("id", F.to_json(F.struct("id", F.lit("zażółć").alias("t"))).alias("doc")).repartition(7)
    path = str(tmp_path / "out" / "doc.json")
    os.mkdir(tmp_path / "out")
    documents.write_document(df, ["id"], "doc", path, "rows", {"version": 1, "note": "ł"})
    doc = json.load(open(path, encoding="utf-8"))
    assert list(doc) == ["version", "note", "rows"] and [x["id"] for x in doc["rows"]] == list(range(5000)) and doc["rows"][0]["t"] == "zażółć"
    documents.write_document(df.limit(0), ["id"], "doc", path, "rows", {})
    assert json.load(open(path)) == {"rows": []} and os.listdir(tmp_path / "out") == ["doc.json"]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    open(path, "w").write("old")
    bad = spark.range(9).select("id", F.when(F.col("id") == 7, F.raise_error("no")).otherwise("{}").cast("string").alias("doc"))
    with pytest.raises(Exception, match="no"):
        documents.write_document(bad, ["id"], "doc", path, "rows", {})
    assert os.listdir(tmp_path) == ["doc.json"] and open(path).read() == "old"


def test_reports_and_manifests_read_back(spark, tmp_path):
    videos = spark.createDataFrame([(2, "b", None, 1.5, [("x", 1.0, '{"n": [1]}')]), (1, "a", "h", 0.5, [("y", 2.0, None), ("z", 3.0, "text")])], "video_no int, path string, hash string, total_duration_ms double, entries array<struct<name:string,duration_ms:double,details:string>>")
    path = str(tmp_path / "report.json")
    documents.write_report(videos, path, "abc", True, {"k": "v"}, "2024-01-01T00:00:00Z")
    head = json.load(open(path))
    assert (head["version"], head["git_commit"], head["dirty"], head["config"], [v["path"] for v in head["videos"]]) == (1, "abc", True, {"k": "v"}, ["a", "b"])
    got = [(x["path"], x["span_no"], x["name"], x["d"]) for x in f.report_spans(f.read_reports(spark, path)).withColumn("d", F.col("details").cast("string")).collect()]
    assert got == [("a", 0, "y", None), ("a", 1, "z", None), ("b", 0, "x", '{"n":[1]}')]
    media = spark.createDataFrame([(1, "b.mkv", "B", None, None, None, "movie", False), (2, "a.mkv", "A", "a", 1, 2, "episode", True)], "media_id int, source_file string, title string, parsed_title string, season int, episode int, media_type string, is_anime boolean")
    tracks = spark.createDataFrame([(2, 3, "ass", "pol"), (2, 1, "subrip", "eng")], "media_id int, stream_no int, codec string, language string")
    documents.write_manifest(media, tracks, str(tmp_path / "manifest.json"), "/in")
    doc = json.load(open(tmp_path / "manifest.json"))
    assert doc["version"] == 1 and doc["source_dir"] == "/in" and [e["source_file"] for e in doc["entries"]] == ["a.mkv", "b.mkv"]
    assert doc["entries"][0]["identity"] == {"title": "A", "parsed_title": "a", "season": 1, "episode": 2, "media_type": "episode", "is_anime": True}
    assert [x["file"] for x in doc["entries"][0]["subtitles"]] == ["1.srt", "3.ass"] and doc["entries"][1]["subtitles"] == [] and doc["entries"][1]["identity"]["season"] is None


def test_memory_deltas_of_mixed_details(spark):
    rows = [("a", '{"rss_before_mb": 10, "rss_after_load_mb": "30.5"}'), ("a", '{"rss_before_mb": "x", "rss_after_load_mb": 1, "rss_after_translate_mb": 5}'), ("a", "[]"), ("a", None), ("b", "{}")]
    df = spark.createDataFrame([("r", *x) for x in rows], "run string, name string, t string").withColumn("details", F.try_parse_json("t"))
    assert sorted(map(tuple, r.memory_deltas(df).collect())) == [("r", "a", 2, 20.5, 4.0), ("r", "b", 0, None, None)]


def test_fonts_by_beginnings_of_every_length(spark):
    styles = spark.createDataFrame([(1, "Open_Sans"), (1, "O"), (1, "Zed Sans Bold"), (1, None), (2, "")], "media_id int, fontname string")
    fonts = spark.createDataFrame([("open-sans-bold", ["a"]), ("Open Sans", ["a"]), ("zed", ["a"]), ("oh", ["b"]), ("other", ["a"])], "stem string, letters array<string>")
    got = {(x["media_id"], x["fontname"]): x["stem"] for x in s.pick_font(styles, fonts, "a").collect()}
    spare = got[1, None]
    assert got == {(1, "Open_Sans"): "Open Sans", (1, "O"): "Open Sans", (1, "Zed Sans Bold"): spare, (1, None): spare, (2, ""): spare}
    assert s.pick_font(styles, fonts.limit(0), "a").count() == 0


def test_identity_precedence(spark):
    names = "media_id int, file_name string, folder_name string, container_title string, ani_title string, ani_season int, ani_episode int, ani_year int, release_group string, is_anime boolean, guess_title string, guess_season int, guess_episode int, guess_year int, guess_type string, folder_title string, folder_season int"
    rows = [
        (1, "f", "d", None, "Ani", 0, 4, None, "G", True, "Guess", 2, 9, 1999, "movie", "Folder", 7),
        (2, "f", "d", "Box", "Ani", 3, None, None, None, False, "Guess", None, 9, 1999, "movie", None, None),
        (3, "f", "d", "", None, None, None, None, None, None, None, None, None, None, "movie", None, 5),
        (4, "f", None, None, "", None, None, None, None, True, "", None, None, None, "movie", None, 5),
        (5, "f", "d", None, None, None, None, None, None, False, "T", 0, None, None, "movie", None, None),
    ]
    got = sorted(map(tuple, s.merge_identity(spark.createDataFrame(rows, names)).select("media_id", "title", "year", "season", "episode", "media_type").collect()))
    assert got == [(1, "Ani", 1999, 2, 4, "episode"), (2, "Box", 1999, 3, 9, "episode"), (3, "d", None, 5, None, "episode"), (4, "f", None, None, None, "movie"), (5, "T", None, None, None, "movie")]


def test_a_document_is_read_in_ranges(spark, tmp_path):
    """No task reads the whole of what many tasks wrote; entries keep their numbers over ranges, and lines of other data are none."""
    df = spark.range(3000).select("id", F.to_json(F.struct("id", F.lit("a\n{[ł").alias("t"))).alias("doc")).repartition(5)
    path, size = str(tmp_path / "doc.json"), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "10000")
    try:
        documents.write_document(df, ["id"], "doc", path, "rows", {"version": 1, "note": "ł"})
        read = documents.read_document(spark, path, "struct<id:bigint,t:string>", "version int, note string")
        assert read.rdd.getNumPartitions() > 5
        assert sorted(tuple(x) for x in read.select("version", "note", "entry_no", "e.id", "e.t").collect()) == [(1, "ł", i, i, "a\n{[ł") for i in range(3000)]
    finally:
        spark.conf.set(size, before)
    documents.write_document(df.limit(0), ["id"], "doc", path, "rows", {})
    assert documents.read_document(spark, path, "struct<id:bigint>").count() == 0


@pytest.mark.parametrize("name", ["s14_write_manifest", "s15_report_round_trip"])
def test_no_query_reads_its_document_whole(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " text" in plan and "json" not in [x.split()[-1] for x in plan.splitlines() if "Relation" in x]


def test_a_large_file_of_responses_is_read_in_ranges(spark, tmp_path):
    """Each line goes to one range, wherever the cuts fall, also with long lines and none at the end; a body that is no text is JSON again."""
    rows = [(i, "other", None, i % 2 == 0, ("zażółć " * (i % 40)) + str(i)) for i in range(60)]
    path = str(tmp_path / "saved")
    os.mkdir(path)
    lines = "\n".join(json.dumps(dict(zip(("media_id", "source", "raw_filename", "hash_match", "body"), x)), ensure_ascii=False) for x in rows)
    (tmp_path / "saved" / "one.json").write_text(lines, encoding="utf-8")
    (tmp_path / "saved" / "two.json").write_text('{"media_id": 60, "source": "other", "body": {"data": [1]}, "more": 1}\n')
    (tmp_path / "saved" / "none.json").write_text("")
    first = len(lines.encode().split(b"\n")[0])
    for size in (1 << 20, 5000, 997, 64, 1, first, first + 1, first + 2):
        reader = responses._Reader(path, size)
        got = [x for p in reader.partitions() for batch in reader.read(p) for x in batch.to_pylist()]
        assert [tuple(x.values()) for x in got] == [*rows, (60, "other", None, None, '{"data": [1]}')], size
    spark.dataSource.register(responses.SavedResponses)
    read = spark.read.format("saved_responses").option("range_bytes", 2000).load(path)
    assert read.rdd.getNumPartitions() > 5 and read.count() == 61 and read.selectExpr("sum(media_id)").first()[0] == sum(range(61))


def test_the_bodies_are_made_in_one_pass_over_the_orders(spark, monkeypatch):
    """One shuffle for the bodies of the three services."""
    from subtide.plans import edge_queries

    seen = []
    monkeypatch.setattr(responses, "save_responses", lambda df, path: seen.append(df._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(responses, "read_responses", lambda s, path: s.createDataFrame([], responses.RESPONSE))
    edge_queries.QUERIES["f1_saved_responses"](spark, "/root/testdata/sf0.001")
    assert seen[0].count("Aggregate") == 1 and seen[0].count("Relation") == 1
