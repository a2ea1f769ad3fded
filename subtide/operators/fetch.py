"""The fetch chain: found candidates and their files to the subtitles kept for each media, Polish ones aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from subtide.operators.match import align_plan, apply_shift, line_match_score
from subtide.session import held, written
from subtide.sources.files import normalize_encoding, parse_srt

KEY = ["media_id", "source", "subtitle_id"]


def distinct_files(files: DataFrame) -> DataFrame:
    """(pair_id, media_id, content, names): each content that a media's files (media_id, source, subtitle_id, content) have, once, with a number and the source and id of every file that has it."""
    same = files.groupBy("media_id", F.sha2("content", 256).alias("_k")).agg(F.first("content").alias("content"), F.collect_set(F.struct("source", "subtitle_id")).alias("names"))
    return written(same.select(F.monotonically_increasing_id().alias("pair_id"), "media_id", "content", "names"), "files")


def candidate_cues(files: DataFrame) -> DataFrame:
    """Cues of SRT files (pair_id, content as binary) whatever their encoding. Null contents have none."""
    texts = files.select(F.col("pair_id").alias("track_id"), normalize_encoding("content").cast("string").alias("text"))
    return parse_srt(texts.where("text IS NOT NULL")).withColumnRenamed("track_id", "pair_id")


def keep_valid(found: DataFrame, scores: DataFrame, referenced: DataFrame, least: float = 0.5, also: float = 0.8) -> DataFrame:
    """``found`` with match_score and place: what is kept of each media and language.

    With a reference (``referenced``: media_id): the candidate that matches it best, from ``least`` on, and others from ``also`` on.
    Without: the first found, with no match_score. Equal ones keep the order of the search: score, hash match, source, id.
    """
    rated = found.join(scores.select("pair_id", F.col("score").alias("match_score")), "pair_id", "left").join(referenced.withColumn("_ref", F.lit(True)), "media_id", "left")
    rated = rated.withColumn("match_score", F.when(F.col("_ref"), F.col("match_score"))).where(F.col("_ref").isNull() | (F.col("match_score") >= least))
    place = F.row_number().over(Window.partitionBy("media_id", "language").orderBy(F.desc("match_score"), F.desc("score"), F.desc("hash_match"), "source", "subtitle_id"))
    return rated.withColumn("place", place).where((F.col("place") == 1) | (F.col("match_score") >= also)).drop("_ref")


def fetch_subtitles(found: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """What is kept of each media and language, in place order, with the shift of each and the extent of its cues after it.

    found: candidates of all searches (media_id, source, subtitle_id, language, score, hash_match), an id once;
    files: their downloads (see :func:`distinct_files`), those that failed being absent; references: cues of
    the media's English track (media_id, cue_no, start_ms, end_ms). Only Polish subtitles of media with a
    reference are aligned. Services often have the same file of a media: each content is read, scored and aligned once, for all that have it;
    others of the same content stay as they are if only some of them are Polish.
    Without candidates or files the result is empty.
    """
    once = distinct_files(files)
    cues = written(candidate_cues(once).select("pair_id", "cue_no", "start_ms", "end_ms"), "fetched")
    named = found.join(once.select("media_id", "pair_id", F.inline("names")), KEY)
    ref = lambda pairs: pairs.select("media_id", "pair_id").join(references, "media_id").drop("media_id")
    aligned = F.col("language").eqNullSafe("pol") & F.col("match_score").isNotNull()
    kept = held(keep_valid(named, line_match_score(ref(once), cues), references.select("media_id").distinct()).withColumn("aligned", aligned))
    polish = kept.where("aligned").select("media_id", "pair_id").distinct()
    of = lambda pairs: cues.join(pairs.select("pair_id"), "pair_id", "left_semi")
    plan = held(align_plan(ref(polish), of(polish)))
    moved = apply_shift(of(polish), plan).withColumn("aligned", F.lit(True)).unionByName(of(kept.where("NOT aligned")).withColumn("aligned", F.lit(False)))
    pair = ["pair_id", "aligned"]
    extent = moved.groupBy(*pair).agg(F.count(F.lit(1)).alias("n_cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.sum("start_ms").alias("sum_ms"))
    placed = kept.join(plan.withColumn("aligned", F.lit(True)), pair, "left").join(extent, pair, "left")
    return placed.select("media_id", "language", "place", "source", "subtitle_id", "match_score", "boundary_ms", "pre_ms", "post_ms", "n_cues", "first_ms", "last_ms", "sum_ms")
