"""Benchmark decontamination: a hash set of normalised test n-grams against every training window (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from subtide.session import held

#: Up to so many benchmark windows the hashes are a set that goes out with the scan's tasks; beyond it they are a table.
SET_WINDOWS = 50_000
#: Tables of benchmark windows, and of texts with hits, are broadcast up to so many rows; beyond it they are shuffled.
BROADCAST_WINDOWS = 500_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; all-ASCII texts take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The normalised words; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _window_hash(tokens: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(tokens, at, F.lit(n)))


def benchmark_windows(bench: DataFrame, n: int) -> DataFrame:
    """Distinct windows of the benchmark: length, hash, gram (array of words), items (sorted ids as strings)."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    length = F.least(F.size("tokens"), F.lit(n))
    grams = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - length + 1), lambda i: F.slice("tokens", i, length))).alias("gram"))
    return grams.groupBy(F.size("gram").alias("length"), F.xxhash64("gram").alias("hash"), "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _windows(tokens: Column, length: int) -> Column:
    """(pos, length, hash) of each window of ``length`` words."""
    last = F.size(tokens) - length + 1
    spots = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("length"), _window_hash(tokens, i, length).alias("hash")))


_HITS = "array<struct<pos:int,length:int,hash:bigint>>"


def _small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, to be broadcast if it has no more rows than the limit."""
    limit = BROADCAST_WINDOWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _with_candidates(docs: DataFrame, grams: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, _bm_tokens and _bm_found (windows whose hash the benchmark has) of every row.

    A small benchmark's hashes are tested inside the scan. Those of a larger one are a hash set to join
    with: each distinct text's windows meet it as (text's hash, position, hash), without their words, and
    what hits goes back to the texts.
    """
    tokens = words(F.col("text"))
    known = grams.select("length", "hash").distinct().limit(SET_WINDOWS + 1).collect()
    none = F.array().cast(_HITS)
    if len(known) <= SET_WINDOWS:
        rows = docs.select(*keep, tokens.alias("_bm_tokens"))
        among = {m: [r[1] for r in known if r[0] == m] for m in sorted({r[0] for r in known})}
        found = [F.filter(_windows(F.col("_bm_tokens"), m), lambda w: w["hash"].isin(hashes)) for m, hashes in among.items()]
        return rows.withColumn("_bm_found", F.concat(none, *found))
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # n at most
    of_text = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("_bm_text"), tokens.alias("_bm_tokens"))
    windows = of_text.select("_bm_text", F.explode(F.concat(*[_windows(F.col("_bm_tokens"), m) for m in lengths])).alias("w")).select("_bm_text", "w.pos", "w.length", "w.hash")
    hits = windows.join(_small(grams.select("length", "hash").distinct()), ["length", "hash"], "left_semi")
    per_text = held(hits.groupBy("_bm_text").agg(F.collect_set(F.struct("pos", "length", "hash")).alias("_bm_found")))
    rows = docs.select(*keep, tokens.alias("_bm_tokens"), F.xxhash64("text").alias("_bm_text")).join(_small(per_text), "_bm_text", "left")
    # Two texts of one hash would share candidates: those beyond a text's end go here, others at the check of their words.
    inside = F.filter(F.coalesce(F.col("_bm_found").cast(_HITS), none), lambda w: w["pos"] + w["length"] - 1 <= F.size("_bm_tokens"))
    return rows.select(*keep, "_bm_tokens", inside.alias("_bm_found"))


def hit_windows(docs: DataFrame, bench: DataFrame, n: int = 10, keep: list[str] | None = None, hit_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``keep``, tokens' number ``n_words``, ``hit_pos`` (sorted 1-based positions of
    words inside an occurring window) and ``items`` (sorted ids of items with an occurring window).

    Benchmark items are cut into windows of ``n`` words; an item of fewer words, but not none, is one
    window. Windows whose hash the benchmark has (see _with_candidates) are verified word by word, so
    hash collisions can't count, and one shuffle of hits by row brings a row's hits together. With
    ``hit_only`` rows without a hit are left out, and not shuffled either.

    A null or empty text has no words and no hits. Repeated rows stay repeated, with equal results.
    Null item ids are left out of ``items`` but their windows count. Empty tables are fine. Working
    columns begin with ``_bm_``; columns not named in ``keep`` are dropped.
    """
    grams = benchmark_windows(bench, n)
    keep = docs.columns if keep is None else keep
    rows = _with_candidates(docs, grams, keep).withColumn("_bm_row", F.monotonically_increasing_id())
    spread = F.explode if hit_only else F.explode_outer
    hits = rows.select(*keep, "_bm_row", "_bm_tokens", spread("_bm_found").alias("_bm_hit")).select(
        *keep, "_bm_row", F.size("_bm_tokens").alias("_bm_words"), "_bm_hit",
        F.when(F.col("_bm_hit").isNotNull(), F.expr("slice(_bm_tokens, _bm_hit.pos, _bm_hit.length)")).alias("_bm_gram"),
    )
    side = grams.select(F.col("hash").alias("_bm_h"), F.col("gram").alias("_bm_g"), F.col("items").alias("_bm_items"))
    # Rows without a hit have no key; dealt by row number they don't meet in one task.
    key = F.coalesce("_bm_hit.hash", "_bm_row")
    checked = hits.join(_small(side), (key == F.col("_bm_h")) & (F.col("_bm_gram") == F.col("_bm_g")), "inner" if hit_only else "left")
    span = F.when(F.col("_bm_g").isNotNull(), F.sequence(F.col("_bm_hit.pos"), F.col("_bm_hit.pos") + F.col("_bm_hit.length") - 1))
    first = [F.first(c).alias(c) for c in [*keep, "_bm_words"]]
    out = checked.groupBy("_bm_row").agg(*first, F.collect_set(span).alias("_bm_spans"), F.collect_set("_bm_items").alias("_bm_lists"))
    return out.select(
        *keep,
        F.col("_bm_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten("_bm_spans"))).alias("hit_pos"),
        F.array_sort(F.array_distinct(F.flatten("_bm_lists"))).alias("items"),
    )


def contamination(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids, sorted as strings, comma-joined), contaminated; a row per document row."""
    found = hit_windows(docs, bench, n, keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit_pos").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_pos") > 0).alias("contaminated"),
    )


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _texts_with_hits(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """(_bm_digest, _bm_pos): the texts in which a window of ``bench`` occurs, and the positions of hit words; narrow, and checkpointed."""
    found = hit_windows(docs.select(_digest(F.col("text")).alias("_bm_digest"), "text"), bench, n, keep=["_bm_digest"], hit_only=True)
    return held(found.groupBy("_bm_digest").agg(F.first("hit_pos").alias("_bm_pos")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the rows in which a window of ``bench`` occurs; columns as they were.

    Texts go through no shuffle: digests of the texts with hits are found first and left out in a second scan.
    """
    hit = _small(_texts_with_hits(docs, bench, n).select("_bm_digest"))
    return docs.join(hit, _digest(docs["text"]) == hit["_bm_digest"], "left_anti")


def cut_spans(docs: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with the words of occurring windows, and the separators after them, cut out of ``text``; other columns as they were."""
    found = docs.join(_small(_texts_with_hits(docs, bench, n)), _digest(docs["text"]) == F.col("_bm_digest"), "left")
    texts = docs["text"]
    cased = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # the same words before lower-casing
    gaps, parts = F.split(texts, cased), F.regexp_extract_all(texts, F.lit(cased), F.lit(0))
    kept = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(F.array_contains("_bm_pos", i), F.lit("")).otherwise(F.concat(F.get(parts, i - 1), F.get(gaps, i))))
    cut = F.when(F.col("_bm_pos").isNotNull(), F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))).otherwise(texts)
    return found.select(*[cut.alias(c) if c == "text" else docs[c] for c in docs.columns])
