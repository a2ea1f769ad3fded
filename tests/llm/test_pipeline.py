import os

import corpus_pipeline
import numpy as np
from tests_llm_helpers import brute, contaminated
from tokenizers import Tokenizer

from subtide.llm.vocabulary import word_bpe_path

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", "x", 0), (9002, "12 !! 34", "en", "x", 8), (9003, "", None, "x", 0)]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: r["text"] for d, r in rows.items() if any(c.isalpha() for c in r["text"])}
    groups = brute(list(left.items()))
    left = {d: t for d, t in left.items() if groups[d] == d}
    left = {d: t for d, t in left.items() if not contaminated(t, bench)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == left.keys() and 0 < len(left) < len(rows)
    library = Tokenizer.from_file(word_bpe_path())
    for d, r in got.items():
        ids = library.encode(left[d], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert (r["lang"], r["source"]) == (rows[d]["lang"], rows[d]["source"])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF).count() == 0
