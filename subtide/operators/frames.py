"""Operators on sampled video frames and the text recognised on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _runs(ocr: DataFrame) -> DataFrame:
    """Runs of equal text in frame order: media_id, text, start, next (start of the next run), last_ts of the media."""
    order = Window.partitionBy("media_id").orderBy("ts_ms", "frame_no")
    new = F.coalesce(F.lag("text").over(order) != F.col("text"), F.lit(True))
    whole = Window.partitionBy("media_id")
    starts = ocr.withColumns({"_new": new, "last_ts": F.max("ts_ms").over(whole)}).where("_new")
    return starts.select("media_id", "frame_no", "text", F.col("ts_ms").alias("start_ms"), F.lead("ts_ms").over(order).alias("_next"), F.lead("text").over(order).alias("_next_text"), "last_ts")


def ocr_lines_burned_in(ocr: DataFrame) -> DataFrame:
    """Lines from frames that have text: each lasts until the next text; texts of one character are dropped; the last line ends a second after the last text."""
    runs = _runs(ocr.where("text <> ''")).where(F.length("text") > 1)
    return runs.select("media_id", "start_ms", F.coalesce("_next", F.col("last_ts") + 1000).alias("end_ms"), "text")


def ocr_lines_pgs(ocr: DataFrame) -> DataFrame:
    """Lines from all frames: closed by a change or a blank; one that begins at 0 and is closed by a change is lost; the last ends three seconds after the last frame."""
    runs = _runs(ocr).where("text <> ''")
    lost = (F.col("start_ms") <= 0) & (F.coalesce("_next_text", F.lit("")) != "")
    return runs.where(~lost).select("media_id", "start_ms", F.coalesce("_next", F.col("last_ts") + 3000).alias("end_ms"), "text")


def frame_stats(frames: DataFrame) -> DataFrame:
    """variance of each frame's pixels, and diff: the mean absolute difference from the frame before (null for the first)."""
    order = Window.partitionBy("media_id").orderBy("frame_no")
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + f(x))
    n = F.size("pixels")
    with_prev = frames.withColumn("_prev", F.lag("pixels").over(order))
    mean = total(F.col("pixels"), lambda x: x.cast("long")) / n
    squares = total(F.col("pixels"), lambda x: x.cast("long") * x) / n
    gaps = F.aggregate(F.zip_with("pixels", "_prev", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x) / n
    return with_prev.select("media_id", "frame_no", "ts_ms", (squares - mean * mean).alias("variance"), F.when(F.col("_prev").isNotNull(), gaps).alias("diff"))


def transition_frames(frames: DataFrame, change: float = 15.0, text_variance: float = 200.0) -> DataFrame:
    """Frames to recognise: those that differ from the one before and have text, and the first if it has text; all of a media with fewer than two."""
    s = frame_stats(frames).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("media_id")))
    kept = (F.col("_n") < 2) | ((F.col("variance") > text_variance) & (F.col("diff").isNull() | (F.col("diff") > change)))
    return s.where(kept).select("media_id", "frame_no", "ts_ms")


def transitions(frames: DataFrame, change: float = 15.0, text_variance: float = 200.0) -> DataFrame:
    """Where subtitles appear and disappear. Whether there is text is remembered from the last frame that differed from its predecessor."""
    order = Window.partitionBy("media_id").orderBy("frame_no")
    s = frame_stats(frames).withColumns({"_text": F.col("variance") > text_variance, "_moved": F.col("diff").isNull() | (F.col("diff") > change)})
    before = F.last(F.when(F.col("_moved"), F.col("_text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(F.col("_text"), "appeared").when(F.col("_before"), "disappeared")
    return s.withColumn("_before", before).where(F.col("diff") > change).select("media_id", "frame_no", "ts_ms", kind.alias("kind")).where("kind IS NOT NULL")


def last_clean_frame(frames: DataFrame) -> DataFrame:
    """For each frame with a subtitle the latest one before it without; null if there is none."""
    order = Window.partitionBy("media_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    clean = F.last(F.when(~F.col("has_subtitle"), F.col("frame_no")), ignorenulls=True).over(order)
    return frames.withColumn("clean_no", clean).where("has_subtitle").select("media_id", "frame_no", "clean_no")


def subtitle_frames(results: DataFrame, fps: float) -> DataFrame:
    """(media_id, frame, boxes): the frames of the second after each result with text and boxes; the later result has a frame that two cover."""
    at = lambda ms: F.floor(ms * F.lit(float(fps)) / 1000)
    spread = results.where("has_subtitle AND size(boxes) > 0").select("media_id", "frame_no", "boxes", F.explode(F.sequence(at(F.col("ts_ms")), at(F.col("ts_ms") + 1000) - 1)).alias("frame"))
    return spread.groupBy("media_id", "frame").agg(F.max_by("boxes", "frame_no").alias("boxes"), F.max("frame_no").alias("from_no"))


def scene_cut(pixels: DataFrame, threshold: float = 0.4, bins: int = 64, top: float = 0.5) -> DataFrame:
    """Similarity of each frame's histogram with the frame before's, over the first ``top`` of its pixels, and whether that is a cut."""
    head = F.slice("pixels", 1, F.greatest(F.lit(1), F.floor(F.size("pixels") * top)).cast("int"))
    hist = pixels.select("media_id", "frame_no", F.explode(head).alias("v")).groupBy("media_id", "frame_no", F.least(F.floor(F.col("v") * bins / 256), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    share = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("media_id", "frame_no"))).drop("n")
    prev = share.select("media_id", (F.col("frame_no") + 1).alias("frame_no"), "bin", F.col("p").alias("q"))
    both = share.join(prev, ["media_id", "frame_no", "bin"], "full")
    score = both.groupBy("media_id", "frame_no").agg(F.sum(F.least(F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0)))).alias("similarity"), F.count("p").alias("_p"), F.count("q").alias("_q"))
    return score.where("_p > 0 AND _q > 0").select("media_id", "frame_no", "similarity", (F.col("similarity") < threshold).alias("is_cut"))


def burned_in_probe(ocr: DataFrame, n: int = 100, least_length: int = 8, share: float = 0.08) -> DataFrame:
    """Whether a media has burned-in text: ``n`` frames from its middle nine tenths, in the order of ``frame_hash``, of which enough show a text long enough."""
    at = Window.partitionBy("media_id").orderBy("ts_ms", "frame_no")
    total = Window.partitionBy("media_id")
    middle = ocr.withColumns({"_r": F.row_number().over(at), "_n": F.count(F.lit(1)).over(total)}).where("_r > _n * 0.05 AND _r <= _n * 0.95")
    sample = middle.withColumn("_s", F.row_number().over(Window.partitionBy("media_id").orderBy("frame_hash", "frame_no"))).where(F.col("_s") <= n)
    hits = sample.groupBy("media_id").agg(F.count_if(F.length("text") >= least_length).alias("hits"), F.count(F.lit(1)).alias("sampled"))
    return hits.withColumn("burned_in", F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("sampled") * share)))


def map_boxes(boxes: Column, crop_ratio: float) -> Column:
    """Boxes found on the lowest ``crop_ratio`` of the frame, in coordinates of the whole frame."""
    return F.transform(boxes, lambda b: F.struct(b["x"].alias("x"), (F.lit(1 - crop_ratio) + b["y"] * crop_ratio).alias("y"), b["width"].alias("width"), (b["height"] * crop_ratio).alias("height")))


def crop_region(boxes: Column, width: int, height: int, padding: int = 40) -> Column:
    """Pixel rows that hold all boxes and a margin, over the full width."""
    low = F.array_min(F.transform(boxes, lambda b: b["y"]))
    high = F.array_max(F.transform(boxes, lambda b: b["y"] + b["height"]))
    return F.struct(F.lit(0).alias("x1"), F.greatest(F.lit(0), F.floor(low * height) - padding).alias("y1"), F.lit(width).alias("x2"), F.least(F.lit(height), F.floor(high * height) + padding).alias("y2"))


def remap_boxes(boxes: Column, region: Column, width: int, height: int) -> Column:
    """Boxes in coordinates of the crop ``region``."""
    w, h = region["x2"] - region["x1"], region["y2"] - region["y1"]
    return F.transform(boxes, lambda b: F.struct(((b["x"] * width - region["x1"]) / w).alias("x"), ((b["y"] * height - region["y1"]) / h).alias("y"), (b["width"] * width / w).alias("width"), (b["height"] * height / h).alias("height")))


def mask_rect(box: Column, width: int, height: int, dilation: int = 20) -> Column:
    """Pixel rectangle of a box and a margin, kept inside the frame."""
    return F.struct(
        F.greatest(F.lit(0), F.floor(box["x"] * width) - dilation).alias("x1"), F.greatest(F.lit(0), F.floor(box["y"] * height) - dilation).alias("y1"),
        F.least(F.lit(width), F.floor((box["x"] + box["width"]) * width) + dilation).alias("x2"), F.least(F.lit(height), F.floor((box["y"] + box["height"]) * height) + dilation).alias("y2"),
    )
