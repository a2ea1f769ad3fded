"""How far the sources of a language differ in their terms, from exact products of one-hot levels.

A kept term is a row; the columns say of a (source, count) level whether the term has that count in that source.
The matrix times its transpose counts, for each two sources and each two counts, the terms that have them: the
joint table. Prices of counts then turn joint tables into distances without going back to the terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.llm.words import slices
from subtide.session import written

#: A kept term is in so many documents of its language at least.
MIN_DOCS = 30
#: Added to each count before shares are taken, and the share that 1 stands for.
SMOOTHING = 5
SCALE = 1_000_000_000
#: Terms reported for a group.
TOP_TERMS = 50
#: (source, term) counts held before they are sent on.
HELD_COUNTS = 1 << 18
SLICE_BYTES = 16 << 20
#: Terms and columns of a block: products are of whole numbers below 2^24, so exact in 32-bit floating point.
BLOCK_TERMS = 1024
BLOCK_COLUMNS = 1024

#: Letters A-Z become small, a-z and every byte of a longer character stay, others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows with it), pre-aggregated by task: rows of one key may recur.

    Null text, lang and source are ''. A text's terms are runs of letters A-Z (lower-cased), a-z and characters beyond ASCII.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            lang, source, term, n, in_docs = [], [], [], [], []
            for (a, b), (count, rows_with) in held.items():
                lang += [a] * len(count)
                source += [b] * len(count)
                term += count
                n += count.values()
                in_docs += [rows_with[t] for t in count]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

        size = 0
        for batch in rows:
            at = 0
            for texts in slices(batch.column(2), SLICE_BYTES):
                langs, sources = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (0, 1))
                at += len(texts)
                for lang, source, text in zip(langs, sources, texts.cast(pa.binary())):
                    words = (text.as_py() or b"").translate(_FOLD).split()
                    count, rows_with = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                    size -= len(count)
                    count.update(words)
                    rows_with.update(set(words))
                    size += len(count)
                    if size > HELD_COUNTS:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.select("lang", "source", "text").mapInArrow(batches, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n and cells (source, n) of each term in at least ``min_docs`` documents of its language, as a table in the shared folder."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return written(by_term.where(F.col("docs") >= min_docs).drop("docs"), "terms")


def joint_tables(terms: DataFrame) -> DataFrame:
    """lang, source, level, other, other_level, n: in how many terms two sources (source < other) have these counts, both above 0.

    ``terms``: lang, term, n, cells, with one cell for a source. Any rows of a language make a block, so blocks are cut from
    partitions as they come, terms of like frequency together, since these share levels; the tables are the sums over blocks.
    """

    def products(lang: str, cells: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        of: dict[tuple[str, int], int] = {}
        rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        columns = np.array([of.setdefault((x["source"], x["n"]), len(of)) for c in cells for x in c], np.int64)
        levels = list(of)
        source = np.array([s for s, _ in levels], object)
        count = np.array([n for _, n in levels], np.int64)

        def hot(begin: int) -> np.ndarray:
            there = (columns >= begin) & (columns < begin + BLOCK_COLUMNS)
            out = np.zeros((len(cells), min(BLOCK_COLUMNS, len(levels) - begin)), np.float32)
            out[rows[there], columns[there] - begin] = 1
            return out

        for left in range(0, len(levels), BLOCK_COLUMNS):
            of_left = hot(left)
            for right in range(left, len(levels), BLOCK_COLUMNS):
                product = of_left.T @ (of_left if right == left else hot(right))
                i, j = np.nonzero(np.triu(product, 1) if right == left else product)
                n = product[i, j].astype(np.int64)
                i, j = i + left, j + right
                turned = source[i] > source[j]
                i, j = np.where(turned, j, i), np.where(turned, i, j)
                made = [pa.array([lang] * len(n), pa.string()), pa.array(source[i], pa.string()), pa.array(count[i]), pa.array(source[j], pa.string()), pa.array(count[j]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(made, names=["lang", "source", "level", "other", "other_level", "n"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            block: list[list[dict]] = []
            of, levels = None, set()
            for lang, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = cells.as_py()
                new = {(x["source"], x["n"]) for x in cells}
                if block and (lang != of or len(block) == BLOCK_TERMS or len(levels | new) > BLOCK_COLUMNS):
                    yield from products(of, block)
                    block, levels = [], set()
                of = lang
                block.append(cells)
                levels |= new
            if block:
                yield from products(of, block)

    blocks = terms.sortWithinPartitions("lang", "n").select("lang", "cells")
    tables = blocks.mapInArrow(batches, "lang string, source string, level bigint, other string, other_level bigint, n bigint")
    return tables.groupBy("lang", "source", "level", "other", "other_level").agg(F.sum("n").alias("n"))


def price(level: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (level + SMOOTHING) / (total + SMOOTHING * kept)) in whole numbers; a source without kept terms has no levels to price (0)."""
    level, total, kept = (F.col(c) if isinstance(c, str) else c for c in (level, total, kept))
    up = F.lit(SCALE).cast("decimal(10,0)") * (level + SMOOTHING).cast("decimal(20,0)")
    down = (total + SMOOTHING * kept).cast("decimal(20,0)")
    return F.when(down > 0, F.call_function("div", up, down) + 1).otherwise(0)


def pair_values(joint: DataFrame, levels: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, other, value for source < other of a language: the difference of their prices, summed over all kept terms.

    ``levels``: lang, source, level above 0, n (terms with it). ``totals``: lang, source, total, kept. A price table never holds
    level 0: what a level adds to a pair over level 0 goes by its own count, and what two levels add over both of these by
    the joint count, so terms that neither source has cost one product.
    """
    zero = totals.withColumn("zero", price(F.lit(0), "total", "kept"))
    a = zero.select("lang", "source", F.col("total").alias("a_total"), F.col("zero").alias("a_zero"), "kept")
    b = zero.select("lang", F.col("source").alias("other"), F.col("total").alias("b_total"), F.col("zero").alias("b_zero"))
    pairs = a.join(b, "lang").where("source < other")
    none = F.abs(F.col("a_zero") - F.col("b_zero"))
    base = pairs.select("lang", "source", "other", (none * F.col("kept")).alias("value"))
    one = levels.withColumnRenamed("level", "a_level").join(zero.withColumnRenamed("zero", "a_zero"), ["lang", "source"]).withColumn("p", price("a_level", "total", "kept"))
    against = one.join(zero.select("lang", F.col("source").alias("other"), F.col("zero").alias("b_zero")), "lang").where("source <> other")
    first, second = F.least("source", "other"), F.greatest("source", "other")
    alone = against.select("lang", first.alias("source"), second.alias("other"), ((F.abs(F.col("p") - F.col("b_zero")) - none) * F.col("n")).alias("value"))
    both = joint.join(a, ["lang", "source"]).join(b, ["lang", "other"]).withColumns({"p": price("level", "a_total", "kept"), "q": price("other_level", "b_total", "kept")})
    more = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("b_zero")) - F.abs(F.col("a_zero") - F.col("q")) + none
    together = both.select("lang", "source", "other", (more * F.col("n")).alias("value"))
    return base.union(alone).union(together).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to the others of its language, and the terms it has more of.

    Null text, lang and source are ''. Every occurring (lang, source) is a group, also one without terms. Part ``pair``: the
    other source, and the absolute difference of shares (in billionths) summed over all kept terms, 0 if there are none.
    Part ``term``: a kept term that the group has and whose share there exceeds its share in the language, and by how much,
    up to rank ``top``. Ranks go by value downward, then by item in UTF-8. Repeated rows count as often as they occur; an empty table
    gives none. Only text, lang and source of ``docs`` are read.
    """
    terms = kept_terms(docs, min_docs)
    cells = terms.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells").alias("source", "n"))
    by_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    by_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    filled = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    totals = written(filled, "totals")
    levels = cells.groupBy("lang", "source", F.col("n").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    values = pair_values(joint_tables(terms), levels, totals.drop("lang_total"))
    sides = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = values.select("lang", sides.alias("_side"), "value").select("lang", "_side.source", F.lit("pair").alias("part"), "_side.item", "value")
    priced = cells.join(totals, ["lang", "source"]).withColumn("value", price("n", "total", "kept") - price("lang_n", "lang_total", "kept"))
    over = priced.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # a group's best are taken before the shuffle as well
    return pairs.withColumn("rank", F.row_number().over(order)).union(best)
