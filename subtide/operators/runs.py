"""Comparing pipeline runs: matching videos of two runs, span averages, trees and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.session import held


def stage_set(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and stages: the sorted set of first dotted parts of the span names."""
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_set(F.split_part("name", F.lit("."), F.lit(1)))).alias("stages"))


#: Links that one task joins into components, and steps of a component that one task follows, at a time.
LINKS_A_TASK = 1 << 19
STEPS_A_TASK = 1 << 19


def _forest(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of a task's links (u, v): every node but the smallest of each, with the smallest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up.get(x, x)
        return root

    for pdf in rows:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = sorted((top(u), top(v)))
            if a != b:
                up[b] = a
    nodes = list(up)
    yield pd.DataFrame({"v": pd.Series(nodes, dtype="int64"), "m": pd.Series([top(x) for x in nodes], dtype="int64")})


def link_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (u, v), component being a node of it; a component's own name has no row.

    Each task joins LINKS_A_TASK links; a node then hangs on the least that any task found for it, and what else was found is
    a link between these. So every level leaves only such heads, until one task sees all links that are left.
    """
    links, levels = held(links.where("u <> v").distinct()), []
    while True:
        tasks = -(-links.count() // LINKS_A_TASK)
        found = held((links.coalesce(1) if tasks <= 1 else links.repartition(tasks)).mapInPandas(_forest, "v bigint, m bigint"))
        hung = found.groupBy("v").agg(F.min("m").alias("m"))
        levels.append(hung)
        if tasks <= 1:
            break
        others = found.join(hung.withColumnRenamed("m", "least"), "v").where("m <> least").select(F.col("m").alias("u"), F.col("least").alias("v"))
        heads = hung.join(found.select(F.col("m").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = held(others.union(heads).distinct())
    named = levels.pop().select(F.col("v").alias("node"), F.col("m").alias("component"))
    while levels:
        hung = levels.pop()
        above = named.select(F.col("node").alias("m"), F.col("component").alias("c"))
        here = hung.join(above, "m", "left").select(F.col("v").alias("node"), F.coalesce("c", "m").alias("component"))
        named = held(here.union(named.join(hung.select(F.col("v").alias("node")), "node", "left_anti")))
    return named


def _arrivals(sources: DataFrame, steps: DataFrame) -> DataFrame:
    """(n, t): when each node is first reached. ``sources`` (n, t); ``steps`` (b, h, n): at time b from h to n, if h was reached before b.

    What can be told from bounds is told by joins: a step from a node with an earlier source goes for certain, one that nothing
    reaches in time never does. The rest form components, each followed in order of time by one task, STEPS_A_TASK steps
    at a time: only the times of nodes go on to the next part, so a component of any size fits.
    """
    known = sources.groupBy("n").agg(F.min("t").alias("t"))
    from_, to = known.select(F.col("n").alias("h"), F.col("t").alias("t_h")), known.select("n", F.col("t").alias("t_n"))
    open_ = held(steps.where("h <> n").join(to, "n", "left").where("t_n IS NULL OR b < t_n").join(from_, "h", "left").select("b", "h", "n", "t_h"))
    certain = open_.where("t_h < b").groupBy("n").agg(F.min("b").alias("t"))
    times = held(known.union(certain).groupBy("n").agg(F.min("t").alias("t")))
    earliest = open_.groupBy(F.col("n").alias("h")).agg(F.min("b").alias("_in"))
    unsure = held(open_.where("t_h IS NULL OR t_h >= b").join(earliest, "h").where("_in < b").select("b", "h", "n"))
    if unsure.isEmpty():
        return times
    names = link_components(unsure.select(F.col("h").alias("u"), F.col("n").alias("v"))).withColumnRenamed("node", "h")
    named = unsure.join(names, "h", "left").withColumn("c", F.coalesce("component", "h"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("b", "h", "n")) - 1
    parted = held(named.select("c", "b", "h", "n", F.floor(place / STEPS_A_TASK).alias("part")))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        never = float("inf")
        at = dict(zip(pdf["h"].tolist(), pdf["t_h"].fillna(never).tolist())) | dict(zip(pdf["n"].tolist(), pdf["t_n"].fillna(never).tolist()))
        new = {}
        for b, h, n in sorted(zip(pdf["b"].tolist(), pdf["h"].tolist(), pdf["n"].tolist())):
            if at[h] < b < at[n]:
                at[n] = new[n] = b
        return pd.DataFrame({"n": pd.Series(list(new), dtype="int64"), "t": pd.Series(list(new.values()), dtype="int64")})

    for part in range(parted.agg(F.max("part")).first()[0] + 1):
        from_, to = times.select(F.col("n").alias("h"), F.col("t").alias("t_h")), times.select("n", F.col("t").alias("t_n"))
        some = parted.where(F.col("part") == part).join(from_, "h", "left").join(to, "n", "left").select("c", "b", "h", "n", F.col("t_h").cast("double"), F.col("t_n").cast("double"))
        times = held(times.union(some.groupBy("c").applyInPandas(follow, "n bigint, t bigint")).groupBy("n").agg(F.min("t").alias("t")))
    return times


def match_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_no, after_no, how, excluded) for the videos of two runs.

    Both sides: no (order, unique, below 2^53), hash, media_type, title, season, episode, stages. A video is matched by hash,
    else by identity (null-safe); of several after-videos with one key the last counts; an after-video is
    used once, by the first that comes; a pair whose stages differ is excluded and uses nothing up. Rows
    without hash and without type or title match nothing.

    All that a row needs to know is when its two choices are taken. A choice by hash is taken by its first row that fits; one by
    identity by the first row that fits and whose hash was taken before: so takings arrive along rows in order of time, see
    ``_arrivals``.
    """
    last = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("no"))
    ident = ["media_type", "title", "season", "episode"]
    has_ident = (F.coalesce("media_type", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    a = after.select(F.col("no"), "hash", *ident, "stages")
    by_hash = a.where("hash <> ''").withColumn("_r", F.row_number().over(last("hash"))).where("_r = 1").select("hash", F.col("no").alias("h_no"), F.col("stages").alias("h_stages"))
    by_id = a.where(has_ident).withColumn("_r", F.row_number().over(last(*ident))).where("_r = 1").select(*[F.col(c).alias(f"_{c}") for c in ident], F.col("no").alias("i_no"), F.col("stages").alias("i_stages"))
    b = before.join(by_hash, "hash", "left")
    same = has_ident
    for c in ident:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    b = b.join(by_id, same, "left")
    fits = lambda c: F.coalesce(F.col("stages") == F.col(c), F.lit(True))
    rows = b.select(F.col("no").cast("long").alias("b"), F.col("h_no").cast("long"), F.col("i_no").cast("long"), fits("h_stages").alias("h_ok"), fits("i_stages").alias("i_ok"))
    rows = held(rows.where("h_no IS NOT NULL OR i_no IS NOT NULL"))
    sources = rows.where("h_no IS NOT NULL AND h_ok").select(F.col("h_no").alias("n"), F.col("b").alias("t")).union(rows.where("h_no IS NULL AND i_ok").select("i_no", "b"))
    taken = _arrivals(sources, rows.where("h_no IS NOT NULL AND i_no IS NOT NULL AND i_ok").select("b", F.col("h_no").alias("h"), F.col("i_no").alias("n")))
    for c in ("h_no", "i_no"):
        rows = rows.join(taken.select(F.col("n").alias(c), F.col("t").alias(f"{c}_t")), c, "left")
    is_open = lambda c: F.col(c).isNotNull() & F.coalesce(F.col("b") <= F.col(f"{c}_t"), F.lit(True))
    how = F.when(is_open("h_no"), "hash").when(is_open("i_no"), "identity")
    made = rows.withColumn("how", how).where("how IS NOT NULL")
    by = lambda x, y: F.when(F.col("how") == "hash", x).otherwise(y)
    return made.select(F.col("b").alias("before_no"), by(F.col("h_no"), F.col("i_no")).alias("after_no"), "how", (~by(F.col("h_ok"), F.col("i_ok"))).alias("excluded"))


def compare_runs(before: DataFrame, after: DataFrame, pairs: DataFrame, total: bool = False) -> DataFrame:
    """Per span name that both sides of a pair have: mean before and after over the pairs, their difference, and it in percent (0 if before is 0).

    Of spans that repeat in a video the last counts (``total``: their sum). Spans: video_id, span_no, name, duration_ms; pairs: before_id, after_id.
    """
    pick = F.sum("duration_ms") if total else F.max_by("duration_ms", "span_no")
    side = lambda s, key, name: s.groupBy(F.col("video_id").alias(key), "name").agg(pick.alias(name))
    both = pairs.join(side(before, "before_id", "_b"), "before_id").join(side(after, "after_id", "_a"), ["after_id", "name"])
    m = both.groupBy("name").agg(F.avg("_b").alias("before_ms"), F.avg("_a").alias("after_ms"), F.count(F.lit(1)).alias("n"))
    delta = F.col("after_ms") - F.col("before_ms")
    return m.withColumns({"delta_ms": delta, "delta_pct": F.when(F.col("before_ms") != 0, delta / F.col("before_ms") * 100).otherwise(0.0)})


def compare_summary(compared: DataFrame) -> DataFrame:
    """Totals, overall change in percent and its direction, the biggest win if there is one, and a line per span."""
    total = compared.agg(
        F.sum("before_ms").alias("before_ms"), F.sum("after_ms").alias("after_ms"), F.min_by("name", "delta_pct").alias("_w"), F.min("delta_pct").alias("_p"),
        F.array_join(F.array_sort(F.collect_list(F.format_string("%s %.1f -> %.1f", "name", "before_ms", "after_ms"))), "\n").alias("table"),
    )
    pct = (F.col("after_ms") - F.col("before_ms")) / F.col("before_ms") * 100
    return total.select(
        "before_ms", "after_ms", pct.alias("overall_pct"), F.when(pct < 0, "faster").when(pct > 0, "slower").otherwise("same").alias("direction"), F.when(F.col("_p") < 0, F.col("_w")).alias("biggest_win"), "table"
    )


def run_summary(spans: DataFrame, statuses: list[str]) -> DataFrame:
    """Per run, how many spans ended in each status."""
    return spans.groupBy("run").pivot("status", statuses).count().na.fill(0, statuses)


def fetch_summary(found: DataFrame, files: DataFrame) -> DataFrame:
    """(source, found, downloaded, failed): per service its candidates (media_id, source, subtitle_id), and those whose file is there or isn't; an id found twice counts twice."""
    key = ["media_id", "source", "subtitle_id"]
    there = files.select(*key).distinct().withColumn("_there", F.lit(True))
    joined = found.select(*key).join(there, key, "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count("_there").alias("downloaded"), F.count_if(F.col("_there").isNull()).alias("failed"))


def throughput(spans: DataFrame) -> DataFrame:
    """Spans per second by name, before and after side by side; 0 where no time was spent."""
    rate = F.when(F.sum("duration_ms") > 0, F.count(F.lit(1)) / (F.sum("duration_ms") / 1000)).otherwise(0.0)
    return spans.groupBy("name").pivot("run", ["before", "after"]).agg(rate)


def memory_deltas(spans: DataFrame) -> DataFrame:
    """Per run and span name, from the details (a variant) of its spans: how many say what memory they took, and the means of what loading and translating added.

    ``rss_before_mb``, ``rss_after_load_mb`` and ``rss_after_translate_mb`` may be numbers or text; what isn't there, or is no number, is left out.
    """
    at = lambda name: F.try_variant_get("details", f"$.rss_{name}_mb", "double")
    load, translate = at("after_load") - at("before"), at("after_translate") - at("after_load")
    return spans.groupBy("run", "name").agg(F.count(F.coalesce(load, translate)).alias("n"), F.avg(load).alias("load_mb"), F.avg(translate).alias("translate_mb"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Per run, video and dotted name: total time, parent (the name without its last part) and self time (without direct children)."""
    own = spans.groupBy("run", "video_id", "name").agg(F.sum("duration_ms").alias("total_ms")).withColumn("parent", F.when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"\.[^.]*$", "")))
    kids = own.where("parent IS NOT NULL").groupBy("run", "video_id", F.col("parent").alias("name")).agg(F.sum("total_ms").alias("_k"))
    return own.join(kids, ["run", "video_id", "name"], "left").select("run", "video_id", "name", "parent", "total_ms", (F.col("total_ms") - F.coalesce("_k", F.lit(0.0))).alias("self_ms"))


def stage_rank(name: Column, stages: list[str]) -> Column:
    """Place of the name's first part in ``stages``; after all of them if it is none."""
    at = F.array_position(F.array(*[F.lit(s) for s in stages]), F.split_part(name, F.lit("."), F.lit(1)))
    return F.when(at > 0, at).otherwise(len(stages) + 1)
