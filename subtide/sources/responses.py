"""Search services: what one must offer, searching with it, and saved responses as a data source."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from subtide.operators.select import provider_score
from subtide.sources.files import candidates_from_html, candidates_from_json, candidates_from_xml

CANDIDATE = "media_id bigint, source string, subtitle_id string, language string, release_name string, format string, score double, hash_match boolean"
RESPONSE = "media_id bigint, source string, raw_filename string, hash_match boolean, body string"
_FIELDS = [part.split()[0] for part in RESPONSE.split(", ")]
_ARROW = pa.schema(list(zip(_FIELDS, [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()])))


class Provider(Protocol):
    """A search service. ``search`` gets a media's columns and gives candidates, the best first, as dictionaries of CANDIDATE's fields but media_id and source."""

    name: str

    def search(self, media: dict, languages: list[str]) -> list[dict]: ...

    def download(self, candidate: dict) -> bytes | None: ...


def search_media(media: DataFrame, provider: Callable[[], Provider], languages: list[str]) -> DataFrame:
    """Candidates (CANDIDATE) of every row of ``media`` (media_id and what the service needs). ``provider`` makes the service, once a task."""
    names = [part.split()[0] for part in CANDIDATE.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = provider()
        for pdf in parts:
            rows = [{"media_id": m["media_id"], "source": service.name} | found for m in pdf.to_dict("records") for found in service.search(m, languages)]
            yield pd.DataFrame(rows, columns=names)

    return media.mapInPandas(run, CANDIDATE)


def download_candidates(candidates: DataFrame, provider: Callable[[], Provider]) -> DataFrame:
    """(media_id, source, subtitle_id, content) of the service's candidates; those it gives nothing for, or fails on, have no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = provider()
        for pdf in parts:
            rows = []
            for c in pdf[pdf["source"] == service.name].to_dict("records"):
                try:
                    content = service.download(c)
                except OSError:
                    content = None
                if content is not None:
                    rows.append((c["media_id"], c["source"], c["subtitle_id"], content))
            yield pd.DataFrame(rows, columns=["media_id", "source", "subtitle_id", "content"])

    return candidates.mapInPandas(run, "media_id bigint, source string, subtitle_id string, content binary")


#: Bytes of a file that a task reads, and those it hands on at a time.
RANGE_BYTES = 32 << 20
BUFFER = 1 << 20


@dataclass
class _Range(InputPartition):
    """The lines of a file that begin from byte ``start`` on and before ``end``."""

    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        system, root = self._opened()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".json")]
        return [_Range(f.path, at, min(f.size, at + self.range_bytes)) for f in files for at in range(0, max(f.size, 1), self.range_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = self._opened()
        at, some, size = partition.start, [], 0
        with system.open_input_file(partition.path) as file:
            file.seek(max(0, at - 1))
            lines = io.BufferedReader(file, BUFFER)
            if at:  # a line begins there if the byte before ends one
                at += len(lines.readline()) - 1
            while at < partition.end and (line := lines.readline()):
                some.append(line)
                at += len(line)
                size += len(line)
                if size >= BUFFER:
                    yield self._batch(some)
                    some, size = [], 0
        if some:
            yield self._batch(some)

    @staticmethod
    def _batch(lines: list[bytes]) -> pa.RecordBatch:
        saved = [json.loads(line) for line in lines]
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        columns = [[text(x.get(f.name)) if f.type == pa.string() else x.get(f.name) for x in saved] for f in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class SavedResponses(DataSource):
    """``spark.read.format("saved_responses").load(path)``: responses of services saved as JSON lines, on any file system pyarrow opens.

    A file is a partition, a large one is cut into several: option ``range_bytes`` (32 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "saved_responses"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def save_responses(responses: DataFrame, path: str) -> None:
    """Writes responses (RESPONSE) as the files that the source reads."""
    responses.select(*_FIELDS).write.json(path, ignoreNullFields=False)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SavedResponses)
    return spark.read.format("saved_responses").load(path)


def candidates_of(responses: DataFrame) -> DataFrame:
    """Candidates (CANDIDATE) of saved responses of the three services, each body read by its service's reader; other sources give none."""
    of = lambda name: responses.where(F.col("source") == name)
    html = candidates_from_html(of("animesub").select("media_id", "body"))
    html = html.withColumns({"language": F.lit("pol"), "hash_match": F.lit(False)}).withColumn("score", provider_score(F.col("source"), F.col("hash_match"), F.lit(None).cast("double")))
    names = [part.split()[0] for part in CANDIDATE.split(", ")]
    return candidates_from_json(of("opensubtitles")).select(*names).union(candidates_from_xml(of("podnapisi")).select(*names)).union(html.select(*names))
