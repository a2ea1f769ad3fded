"""From a documents table to token ids: language ID, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's documents. All but the last keep the columns of documents and drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from subtide.llm import bpe, decontaminate, jaccard_join, langid
from subtide.llm.vocabulary import word_bpe_path
from subtide.session import table, written


#: Bytes of rows that go to Python at a time: stages hold whole texts, and workers live on from one stage to the next.
ARROW_BYTES = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches for the stage's action, which its caller runs; the setting stays for the rest of the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).lower().removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter. Whatever the language, the others stay."""
    _small_batches(spark)
    names = docs.columns
    prototypes = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, prototypes, names).where(F.col("lang_pred") != langid.UNKNOWN).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of documents linked by a Jaccard similarity of 0.75 over five-word shingles the one with the smallest doc_id."""
    _small_batches(spark)
    return jaccard_join.first_of_each_group(docs, k=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window (or the whole, if shorter) of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=10)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    _small_batches(spark)
    return bpe.round_trip(docs, word_bpe_path(), keep=["lang", "source"], with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Hyperdimensional profiles and token merges have no SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
