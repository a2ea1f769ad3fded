"""Token ids in ORC files in document order, read back stripe by stripe.

ORC keeps integers in run-length encoded stripes with row indexes (least and greatest doc_id of every
few thousand rows) and Bloom filters on doc_id, so a lookup reads only stripes that can hold the id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from subtide.llm.bpe import END_OF_WORD, byte_letters
from subtide.llm.words import Cutter, WordIds, slices
from subtide.session import fresh_path, held

#: Settings of the ORC writer: stripes of 64 MB, a row index entry every 1000 rows, Bloom filters on the id.
ORC_OPTIONS = {"orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


#: Words that one call to the library encodes, and those whose ids a worker keeps in each of two generations.
CALL_WORDS = 2048
KEPT_WORDS = 1 << 17
SLICE_BYTES = 16 << 20

_loaded: dict[str, WordIds] = {}


def library_ids(path: str) -> WordIds:
    """Ids by the tokenizers library, loaded once a worker.

    The library encodes distinct words, many a call, with blanks between them, which have no ids: a word's last token is one
    that ends a word. Should these not be as many as the words, they are joined by a special token, whose id then tells
    where one word's ids end; that takes the library about twice the time.

    Words of letters alone, which come in their normal form, need not be normalized and cut again: they go in as the letters
    of their bytes, and the library splits at blanks and merges.
    """
    if path not in _loaded:
        library, merging, cutter = Tokenizer.from_file(path), Tokenizer.from_file(path), Cutter(path)
        merging.normalizer, merging.pre_tokenizer = None, WhitespaceSplit()
        for x in (library, merging):
            x.no_truncation()
            x.no_padding()
        letters = {i: letter for i, letter in enumerate(byte_letters()) if i != ord(" ")}
        seam, mark = min(cutter.special.items())
        vocab = library.get_vocab()
        last = np.zeros(1 + max(vocab.values()), bool)
        last[[i for token, i in vocab.items() if token.endswith(END_OF_WORD)]] = True

        def cut(words: list[str], by: Tokenizer) -> list[bytes]:
            def encoded(between: str) -> np.ndarray:
                text = " ".join(words)
                if by is merging and not text.isascii():
                    text = text.encode().decode("latin-1").translate(letters)
                return np.array(by.encode_batch_fast([text.replace(" ", between)], add_special_tokens=False)[0].ids, "<u4")

            ids = encoded(" ")
            cuts = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                data = ids.tobytes()
                return [data[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)]
            ids = encoded(seam)
            cuts, data = np.flatnonzero(ids == mark).tolist(), ids.tobytes()
            return [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]

        def encode(words: list[str]) -> list[bytes]:
            out: dict[str, bytes] = {w: i.to_bytes(4, "little") for w, i in cutter.special.items()}
            of_letters = sorted(filter(str.isalpha, words), key=str.isascii)
            others = [w for w in words if not w.isalpha() and w not in cutter.special]
            for plain, by in ((of_letters, merging), (others, library)):
                for at in range(0, len(plain), CALL_WORDS):
                    some = plain[at : at + CALL_WORDS]
                    out |= zip(some, cut(some, by))
            return list(map(out.__getitem__, words))

        _loaded[path] = WordIds(cutter, encode, KEPT_WORDS, SLICE_BYTES)
    return _loaded[path]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int) -> None:
    """Encodes every whole text and writes (doc_id, ids array<int>) as ORC files below ``path``.

    Each document's ids end in ``end_id``; a null or empty text has that id alone. Files, and rows in
    them, are in ascending doc_id order, nulls first; rows of one doc_id keep the order they are read in,
    and many of them are spread over ranges too. What is shuffled for this is the text, which is smaller
    than its ids. An empty table leaves no data file with rows. Only doc_id and text of
    ``docs`` are read.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end = library_ids(tokenizer), np.array([end_id], np.uint32)
        for batch in rows:
            at = 0
            for part in slices(batch.column(1), SLICE_BYTES):
                found = [x for ids in library.of_texts(part) for x in (ids, end)]
                ends = np.cumsum([0] + [len(ids) + 1 for ids in found[::2]])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), ids], names=["doc_id", "ids"])
                at += len(part)

    order = [F.col("doc_id").asc_nulls_first(), "_row"]
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("doc_id", "text").mapInArrow(batches, "doc_id bigint, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the files below ``path``; filters on doc_id are pushed to stripe statistics and Bloom filters."""
    return spark.read.schema("doc_id bigint, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below ``path``.

    Reads the files' ids once, in parallel by stripe. ``start`` counts the ids of all documents before
    it: totals of each read range go into a prefix sum over ranges, and a running sum inside a range.
    """
    split = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"), F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).cast("int"), F.col("_metadata.file_block_start")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(batch.schema.get_field_index("ids"))
            at = np.asarray(ids.offsets)
            values = np.asarray(ids.values).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "ids"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())], names=[*[n for n in batch.schema.names if n != "ids"], "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(split)]).alias("split"), F.monotonically_increasing_id().alias("seq"), "doc_id", "ids")
    flat = rows.select("split.k0", "split.k1", "split.k2", "seq", "doc_id", "ids")
    index = held(flat.mapInArrow(batches, "k0 int, k1 int, k2 bigint, seq bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"))
    key = ["k0", "k1", "k2"]
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a task reads
    offsets = index.groupBy(*key).agg(F.sum("n_tokens").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
    inside = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(offsets), key)
    return placed.select("doc_id", (F.col("ids_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_file_index(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes ``docs`` as token files (below the shared folder if no ``path`` is given) and returns the index read back from them."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer, path, end_id)
    return token_index(docs.sparkSession, path)
