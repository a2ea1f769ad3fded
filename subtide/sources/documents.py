"""One JSON document written by many tasks: parts first, joined when all are there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from subtide.operators.select import codec_extension, language_code

BUFFER = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Part(WriterCommitMessage):
    place: int
    path: str
    entries: int


class _Writer(DataSourceWriter):
    """Each task writes its entries to a part of its own; the commit copies the parts, in order of partition, between head and end."""

    def __init__(self, options: dict):
        self.path, self.head, self.entries_name = options["path"], options.get("head", "{}"), options["entries"]
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        system, root = _opened(self.parts)
        system.create_dir(root, recursive=True)
        path, n = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.json", 0
        with system.open_output_stream(path) as out:
            for row in iterator:
                out.write(((",\n" if n else "") + row[0]).encode())
                n += 1
        return _Part(task.partitionId(), path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = _opened(self.path)
        head = json.dumps(json.loads(self.head), ensure_ascii=False)[:-1]
        begun = f"{path}.new-{uuid.uuid4().hex}"
        with system.open_output_stream(begun) as out:
            out.write(f"{head}{', ' if head != '{' else ''}{json.dumps(self.entries_name)}: [\n".encode())
            first = True
            for part in sorted((m for m in messages if m is not None and m.entries), key=lambda m: m.place):
                out.write(b"" if first else b",\n")
                first = False
                with system.open_input_stream(part.path) as data:
                    while chunk := data.read(BUFFER):
                        out.write(chunk)
            out.write(b"\n]}\n")
        system.move(begun, path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _opened(self.parts)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class JsonDocument(DataSource):
    """``df.write.format("json_document")`` with options path, entries (the list's name) and head (a JSON object of the fields before it); df has one string column of JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "doc string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_document(entries: DataFrame, order: list[str], doc: str, path: str, name: str, head: dict) -> None:
    """One JSON file: ``head``'s fields, then the list ``name`` of the ``doc`` column (JSON) in ``order``.

    Ranges of the order are written by tasks of their own, so no row and no task holds the whole; the driver copies bytes a buffer at a
    time. The file appears when all is written; a failed write leaves none. Without rows the list is empty.
    """
    entries.sparkSession.dataSource.register(JsonDocument)
    sorted_ = entries.orderBy(*[F.col(c).asc_nulls_first() for c in order]).select(F.col(doc).alias("doc"))
    sorted_.write.format("json_document").mode("append").options(path=path, entries=name, head=json.dumps(head)).save()


def read_document(spark: SparkSession, path: str, entry: str, head: str = "") -> DataFrame:
    """(``head``'s fields, entry_no, e): the list's entries, as ``entry`` (a DDL struct) says, of a file that :func:`write_document` wrote, numbered from 0.

    Such a file has its head on the first line and each entry on one of its own, so tasks read ranges of it; other layouts are for
    ``spark.read.json(path, multiLine=True)``, which reads a file in one task. A range's entries are numbered from the numbers of entries in the
    ranges before it, of which there is one row each.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = lines.where(F.col("value").startswith("{") & ~F.col("value").endswith("["))
    blocks = rows.groupBy("_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(blocks.select("_block", (before - F.col("_first")).alias("_shift"))), "_block")
    made = placed.select((F.col("_at") + F.col("_shift")).cast("int").alias("entry_no"), F.from_json(F.regexp_replace("value", ",$", ""), entry).alias("e"))
    if not head:
        return made
    first = lines.where("_block = 0").where(F.col("value").endswith("[")).select(F.from_json(F.concat("value", F.lit("]}")), head).alias("h"))
    return made.join(F.broadcast(first), how="cross").select("h.*", "entry_no", "e")  # one row


def report_entries(videos: DataFrame) -> DataFrame:
    """(video_no, doc): each video of a run as a report has it."""
    return videos.select("video_no", F.to_json(F.struct(*[c for c in videos.columns if c != "video_no"])).alias("doc"))


def write_report(videos: DataFrame, path: str, commit: str, dirty: bool, config: dict, timestamp: str | None = None) -> None:
    """A run's report: version 1, commit, dirty flag, UTC ``timestamp`` (now if None), config and the videos (video_no, path, hash, identity, total_duration_ms, entries) in order of video_no."""
    head = {"version": 1, "git_commit": commit, "dirty": dirty, "timestamp": timestamp or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "config": config}
    write_document(report_entries(videos), ["video_no"], "doc", path, "videos", head)


def manifest_entries(media: DataFrame, tracks: DataFrame) -> DataFrame:
    """(media_id, source_file, doc): per media its file, identity and subtitles in stream order, also where there are none.

    media: media_id, source_file, title, parsed_title, season, episode, media_type, is_anime; tracks: media_id, stream_no, codec, language.
    """
    sub = F.struct(
        "stream_no", F.concat(F.col("stream_no").cast("string"), codec_extension(F.col("codec"))).alias("file"), language_code(F.col("language")).alias("language"),
    )
    listed = tracks.groupBy("media_id").agg(F.array_sort(F.collect_list(sub)).alias("subtitles"))
    identity = F.struct("title", "parsed_title", "season", "episode", "media_type", "is_anime")
    none = F.from_json(F.lit("[]"), "array<struct<stream_no:int,file:string,language:string>>")
    doc = F.to_json(F.struct("source_file", identity.alias("identity"), F.coalesce("subtitles", none).alias("subtitles")), {"ignoreNullFields": "false"})
    return media.join(listed, "media_id", "left").select("media_id", "source_file", doc.alias("doc"))


def write_manifest(media: DataFrame, tracks: DataFrame, path: str, source_dir: str) -> None:
    """The manifest of a folder: version 1, source_dir and the entries in order of file name."""
    write_document(manifest_entries(media, tracks), ["source_file", "media_id"], "doc", path, "entries", {"version": 1, "source_dir": source_dir})
