"""Matching and aligning candidate tracks with reference tracks.

References and candidates are cue tables keyed by pair_id: one reference and one candidate per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.operators.cues import activity_bins, bin_range

#: Width, in bins, of the buckets in which runs of reference and candidate bins meet.
BUCKET = 600


# -- nearest lines ---------------------------------------------------------------------------------


def nearest_start(both: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate rows (side 1) of ``both`` (keys, side, t, ...) with the distance of t to the nearest reference's (side 0); null without one."""
    order = Window.partitionBy(*keys).orderBy("t", "side")
    start = F.when(F.col("side") == 0, F.col("t"))
    before = F.last(start, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("t"), "side")  # carried from the other end: frames that end with the pair would be read again for every row
    after = F.last(start, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"_b": before, "_a": after}).where("side = 1")
    return near.withColumn("distance", F.least(F.col("t") - F.col("_b"), F.col("_a") - F.col("t"))).drop("_b", "_a")


def nearest_match(ref: DataFrame, cand: DataFrame, tolerance: int = 1500) -> DataFrame:
    """For each candidate cue the distance to the nearest reference start (null without reference) and whether it is within ``tolerance``.

    One sort per pair: both sides lie in one order, and the nearest start on either side is carried along.
    """
    both = ref.select("pair_id", F.col("start_ms").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("cue_no")).union(
        cand.select("pair_id", F.col("start_ms").alias("t"), F.lit(1).alias("side"), F.col("cue_no").cast("long"))
    )
    near = nearest_start(both, ["pair_id"])
    return near.select("pair_id", "cue_no", F.col("t").alias("start_ms"), "distance").withColumn("matched", F.coalesce(F.col("distance") <= tolerance, F.lit(False)))


def line_match_score(ref: DataFrame, cand: DataFrame, tolerance: int = 2000) -> DataFrame:
    """Per pair the share of candidate cues that are matched; pairs without candidate cues are absent (score 0)."""
    m = nearest_match(ref, cand, tolerance).groupBy("pair_id").agg(F.count_if("matched").alias("n_matched"), F.count(F.lit(1)).alias("n_cues"))
    return m.withColumn("score", F.col("n_matched") / F.col("n_cues"))


def validate_candidates(ref: DataFrame, cand: DataFrame, least: float = 0.5) -> DataFrame:
    """Scores of at least ``least`` with their rank, best first."""
    kept = line_match_score(ref, cand).where(F.col("score") >= least)
    return kept.select("pair_id", "score")


def validation_counts(ref: DataFrame, cand: DataFrame, least: float = 0.5) -> DataFrame:
    """How many candidates pass, how many don't, and the best score."""
    return line_match_score(ref, cand).agg(F.count_if(F.col("score") >= least).alias("passed"), F.count_if(F.col("score") < least).alias("rejected"), F.max("score").alias("best"))


# -- cross-correlation -----------------------------------------------------------------------------


def paired_bins(ref: DataFrame, cand: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(pair_id, bin) of either side, both up to the later of the two ends."""
    ends = ref.select("pair_id", "end_ms").union(cand.select("pair_id", "end_ms")).groupBy("pair_id").agg(F.greatest(F.max("end_ms"), F.lit(0)).alias("duration_ms"))
    return tuple(activity_bins(side.join(ends, "pair_id"), width, "pair_id") for side in (ref, cand))


def bin_runs(bins: DataFrame) -> DataFrame:
    """Runs [a, b) of neighbouring bins."""
    order = Window.partitionBy("pair_id").orderBy("bin")
    return bins.withColumn("_g", F.col("bin") - F.row_number().over(order)).groupBy("pair_id", "_g").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b")).select("pair_id", "a", "b")


def overlap_slopes(ref_runs: DataFrame, cand_runs: DataFrame) -> DataFrame:
    """(pair_id, p, w, max_shift): changes of slope of the overlap as a function of the shift.

    Two runs overlap as a trapezoid over the shift, which has four corners. So a pair of runs gives four
    rows, however many bins it has. Reference runs carry their pair's ``max_shift``; runs that no shift within
    it brings together don't meet: candidates are dealt to the buckets they cover, references to those
    they can reach, and the two meet in the first bucket common to both.
    """
    spread = lambda low, high: F.explode(F.sequence(F.floor(low / BUCKET), F.floor((high - 1) / BUCKET)))
    r = ref_runs.select("pair_id", "max_shift", "a", "b", (F.col("a") - F.col("max_shift")).alias("_lo"), (F.col("b") + F.col("max_shift")).alias("_hi"))
    r = r.withColumn("bucket", spread(F.col("_lo"), F.col("_hi"))).withColumn("_rb", F.floor(F.col("_lo") / BUCKET))
    c = cand_runs.select("pair_id", F.col("a").alias("c"), F.col("b").alias("d")).withColumn("bucket", spread(F.col("c"), F.col("d"))).withColumn("_cb", F.floor(F.col("c") / BUCKET))
    met = r.join(c, ["pair_id", "bucket"]).where((F.col("bucket") == F.greatest("_rb", "_cb")) & (F.col("d") > F.col("_lo")) & (F.col("c") < F.col("_hi")))
    corners = [("a - d", 1), ("least(a - c, b - d)", -1), ("greatest(a - c, b - d)", -1), ("b - c", 1)]
    rows = F.array(*[F.struct(F.expr(p).cast("long").alias("p"), F.lit(w).alias("w")) for p, w in corners])
    return met.select("pair_id", "max_shift", F.explode(rows).alias("x")).groupBy("pair_id", "x.p").agg(F.sum("x.w").alias("w"), F.max("max_shift").alias("max_shift"))


def overlaps_at(slopes: DataFrame, shifts: DataFrame) -> DataFrame:
    """(pair_id, shift, n): the overlap, in bins, at each of ``shifts`` (pair_id, shift)."""
    points = slopes.select("pair_id", "p", "w", F.lit(0).alias("asked")).union(shifts.select("pair_id", "shift", F.lit(0).cast("long"), F.lit(1)))
    upto = Window.partitionBy("pair_id").orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    n = F.col("p") * F.sum("w").over(upto) - F.sum(F.col("w") * F.col("p")).over(upto)
    return points.withColumn("n", n).where("asked = 1").select("pair_id", F.col("p").alias("shift"), "n")


def xcorr_pairs(ref_bins: DataFrame, cand_bins: DataFrame, max_shift: int) -> DataFrame:
    """(pair_id, shift, n) for every shift within ±max_shift at which bins of both sides overlap: n of them."""
    pairs = ref_bins.select("pair_id").intersect(cand_bins.select("pair_id")).withColumn("max_shift", F.lit(max_shift).cast("long"))
    slopes = overlap_slopes(bin_runs(ref_bins).join(pairs, "pair_id"), bin_runs(cand_bins))
    spine = pairs.select("pair_id", F.explode(F.sequence(-F.col("max_shift"), F.col("max_shift"))).alias("shift"))
    return overlaps_at(slopes, spine).where("n > 0")


def both_sides(ref: DataFrame, cand: DataFrame, *more: str) -> DataFrame:
    """pair_id, side (0: reference, 1: candidate), start_ms, end_ms and ``more`` of both, in one shuffle by pair: what works by pair on it needs no other."""
    tasks = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = ref.select("pair_id", F.lit(0).alias("side"), "start_ms", "end_ms", *more).union(cand.select("pair_id", F.lit(1), "start_ms", "end_ms", *more))
    return both.repartition(tasks, "pair_id")


def paired_runs(both: DataFrame, keys: list[str], width: int, max_shift_ms: int | Column) -> DataFrame:
    """(keys, side, a, b, max_shift, ref_energy, cand_energy): runs [a, b) of the bins that the cues of a side touch, of keys (pair_id and what divides it) with cues on both sides.

    Cues are merged as intervals in their order, so no bin is ever a row. ``max_shift``: ``max_shift_ms`` (a number, or
    an expression over ``both``) in bins, not beyond the timeline. An energy is the bins of a side.
    """
    pair, place = Window.partitionBy(*keys), Window.partitionBy(*keys, "side").orderBy("_f", "_l")
    end = lambda side: F.max(F.when(F.col("side") == side, F.col("end_ms"))).over(pair)
    bins = F.ceil(F.greatest("_r", "_c", F.lit(0)) / width)
    ms = max_shift_ms if isinstance(max_shift_ms, Column) else F.lit(max_shift_ms)
    first, last = bin_range(F.col("start_ms"), F.col("end_ms"), bins, width)
    spans = both.withColumns({"_r": end(0), "_c": end(1)}).where("_r IS NOT NULL AND _c IS NOT NULL")
    spans = spans.select(*keys, "side", first.alias("_f"), last.alias("_l"), F.least(F.floor(ms / width), bins - 1).cast("long").alias("max_shift")).where("max_shift >= 0 AND _l >= _f")
    reached = F.max("_l").over(place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce(F.col("_f") > reached + 1, F.lit(True)).cast("long"))
    spans = spans.withColumn("_g", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy(*keys, "side", "_g").agg(F.min("_f").alias("a"), (F.max("_l") + 1).alias("b"), F.first("max_shift").alias("max_shift")).drop("_g")
    energy = lambda side: F.sum(F.when(F.col("side") == side, F.col("b") - F.col("a"))).over(pair)
    return runs.withColumns({"ref_energy": energy(0), "cand_energy": energy(1)}).where("ref_energy > 0 AND cand_energy > 0")


def best_shift(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shift with the most overlap within ±max_shift (the lowest of equals), n, and both energies, of :func:`paired_runs`.

    The overlap is straight between corners (see :func:`overlap_slopes`), so its greatest value lies at a corner or at the range's ends. Runs meet
    by bucket as there, but in groups below their pair, which lie where the pair lies; a bucket holds BUCKET bins of candidates and as many runs
    of references as reach them. The range's ends are corners without slope that the first run of a key brings along.
    """
    is_ref, reach = F.col("side") == 0, F.when(F.col("side") == 0, F.col("max_shift")).otherwise(0)
    lo, hi = F.col("a") - reach, F.col("b") + reach
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("side", "a")) == 1
    known = [*keys, "max_shift", "ref_energy", "cand_energy"]
    dealt = runs.withColumn("_first", first).withColumn("_k", F.floor(lo / BUCKET)).withColumn("bucket", F.explode(F.sequence("_k", F.floor((hi - 1) / BUCKET))))
    run = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("a", "b", "_k")))
    groups = dealt.groupBy(*known, "bucket").agg(run(0).alias("_rs"), run(1).alias("_cs"), F.max(F.col("_first") & (F.col("bucket") == F.col("_k"))).alias("_one"))
    corner = lambda p, w: F.struct(p.cast("long").alias("p"), F.lit(w).cast("long").alias("w"))
    ends = F.array(corner(-F.col("max_shift"), 0), corner(F.col("max_shift"), 0))
    sides = groups.where("_one OR (size(_rs) > 0 AND size(_cs) > 0)").select(*known, "bucket", "_cs", "_one", F.posexplode_outer("_rs").alias("_i", "_r"))
    met = sides.select(*known, "bucket", "_r", (F.col("_one") & (F.coalesce("_i", F.lit(0)) == 0)).alias("_one"), F.posexplode_outer("_cs").alias("_j", "_c"))
    a, b, c, d = F.col("_r.a"), F.col("_r.b"), F.col("_c.a"), F.col("_c.b")
    meets = (F.col("bucket") == F.greatest("_r._k", "_c._k")) & (d > a - F.col("max_shift")) & (c < b + F.col("max_shift"))
    corners = F.array(corner(a - d, 1), corner(F.least(a - c, b - d), -1), corner(F.greatest(a - c, b - d), -1), corner(b - c, 1))
    none = F.array().cast("array<struct<p:bigint,w:bigint>>")
    rows = F.concat(F.when(F.coalesce(meets & F.col("_r").isNotNull() & F.col("_c").isNotNull(), F.lit(False)), corners).otherwise(none), F.when(F.col("_one") & (F.coalesce("_j", F.lit(0)) == 0), ends).otherwise(none))
    slopes = met.select(*known, F.explode(rows).alias("x")).groupBy(*known, "x.p").agg(F.sum("x.w").alias("w"))
    upto = Window.partitionBy(*keys).orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    n = F.col("p") * F.sum("w").over(upto) - F.sum(F.col("w") * F.col("p")).over(upto)
    at = slopes.withColumn("n", n).where("p BETWEEN -max_shift AND max_shift")
    best = at.groupBy(*keys, "ref_energy", "cand_energy").agg(F.max(F.struct("n", (-F.col("p")).alias("_s"))).alias("_m"))
    return best.select(*keys, (-F.col("_m._s")).alias("shift"), F.col("_m.n").alias("n"), "ref_energy", "cand_energy")


def offsets(both: DataFrame, keys: list[str], width: int, max_shift_ms: int | Column, least: float | Column) -> DataFrame:
    """(keys, offset_ms) of the sides of ``both``; keys whose best overlap is under ``least`` of the energies' mean are absent."""
    best = best_shift(paired_runs(both, keys, width, max_shift_ms), keys)
    good = best.where(F.col("n") / F.sqrt(F.col("ref_energy") * F.col("cand_energy")) >= least)
    return good.select(*keys, (F.col("shift") * width).alias("offset_ms"))


def estimate_offset(ref: DataFrame, cand: DataFrame, width: int = 100, max_shift_ms: int | Column = 15_000, least: float | Column = 0.4) -> DataFrame:
    """(pair_id, offset_ms): how far the candidate is to be moved. Pairs whose best overlap is under ``least`` of the energies' mean are absent.

    ``max_shift_ms`` and ``least`` are numbers or expressions over pair_id.
    """
    return offsets(both_sides(ref, cand), ["pair_id"], width, max_shift_ms, least)


def similarity(ref: DataFrame, cand: DataFrame, width: int = 2000, max_shift: int = 15) -> DataFrame:
    """(pair_id, score): the greatest overlap within ±max_shift bins over the energies' geometric mean, 1 at most."""
    best = best_shift(paired_runs(both_sides(ref, cand), ["pair_id"], width, max_shift * width), ["pair_id"])
    return best.select("pair_id", F.least(F.lit(1.0), F.col("n") / F.sqrt(F.col("ref_energy") * F.col("cand_energy"))).alias("score"))


# -- density ---------------------------------------------------------------------------------------


def densities(side: DataFrame, keys: list[str], windows: list[int]) -> DataFrame:
    """(keys, window, end_ms, counts): the latest end and how many cues start in each window, from 0 to the last that has one, of every track.

    One shuffle by the first key; a track is one row of as many numbers as it has windows.
    """
    hit = F.greatest(F.floor(F.col("start_ms") / F.col("window")), F.lit(0))
    tasks = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that few bytes are still many tasks: what follows is work, not size
    dealt = side.select(*keys, "start_ms", "end_ms").repartition(tasks, keys[0]).withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    cells = dealt.groupBy(*keys, "window", hit.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("end_ms").alias("end_ms"))
    tracks = cells.groupBy(*keys, "window").agg(F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("_c"))
    empty = lambda x, i: x["bin"] - F.coalesce(F.get("_c", i - 1)["bin"], F.lit(-1)) - 1
    filled = F.transform("_c", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), empty(x, i).cast("int")), F.array(x["n"])))
    return tracks.select(*keys, "window", "end_ms", F.flatten(filled).alias("counts"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def correlated(pairs: DataFrame, keys: list[str], shift: int = 1) -> DataFrame:
    """(keys, score) of rows with window and both sides' densities (r, c, their ends _re, _ce): see :func:`density_correlation`.

    Both are brought to the pair's length, starts past its end in its last window. What a shift leaves out is taken from whole sums.
    """
    n = F.col("n_bins")

    def fitted(x: str) -> Column:
        size = F.size(x)
        short, past = F.concat(F.col(x), F.array_repeat(F.lit(0).cast("long"), n - size)), F.array(_total(F.slice(x, n, size - n + 1)))
        return F.when(size <= n, short).otherwise(F.concat(F.slice(x, 1, n - 1), past))

    squares = lambda x: F.transform(x, lambda v: v * v)
    even = pairs.withColumn("n_bins", F.ceil(F.greatest("_re", "_ce") / F.col("window")).cast("int")).where("n_bins > 0").select(*keys, "n_bins", fitted("r").alias("r"), fitted("c").alias("c"))
    whole = even.select(*keys, "n_bins", "r", "c", _total(F.col("r")).alias("_r"), _total(F.col("c")).alias("_c"), _total(squares("r")).alias("_rr"), _total(squares("c")).alias("_cc"))

    def at(k: int) -> Column:
        m, first, last = n - abs(k), lambda x: F.slice(x, 1, abs(k)), lambda x: F.slice(x, -abs(k), abs(k))
        out_r, out_c = (first, last) if k > 0 else (last, first)  # windows without a partner
        sr, srr, sc, scc = F.col("_r"), F.col("_rr"), F.col("_c"), F.col("_cc")
        if k:
            sr, srr, sc, scc = sr - _total(out_r("r")), srr - _total(squares(out_r("r"))), sc - _total(out_c("c")), scc - _total(squares(out_c("c")))
        src = _total(F.zip_with(F.slice("r", 1 + max(k, 0), m) if k else F.col("r"), F.slice("c", 1 + max(-k, 0), m) if k else F.col("c"), lambda x, y: x * y))
        return F.when(m >= 3, F.struct(m.cast("long").alias("n"), sr.alias("sr"), sc.alias("sc"), srr.alias("srr"), scc.alias("scc"), src.alias("src")))

    sums = F.filter(F.array(*[at(k) for k in range(-shift, shift + 1)]), lambda x: x.isNotNull())

    def corr(x: Column) -> Column:
        vr, vc = x["n"] * x["srr"] - x["sr"] * x["sr"], x["n"] * x["scc"] - x["sc"] * x["sc"]
        return F.when((vr > 0) & (vc > 0), (x["n"] * x["src"] - x["sr"] * x["sc"]) / F.sqrt(vr.cast("double") * vc.cast("double")))

    return whole.select(*keys, sums.alias("_s")).select(*keys, F.greatest(F.coalesce(F.array_max(F.transform("_s", corr)), F.lit(0.0)), F.lit(0.0)).alias("score"))


def density_correlation(ref: DataFrame, cand: DataFrame, window: int, shift: int = 1) -> DataFrame:
    """(pair_id, score): the greatest Pearson correlation of the two densities moved by up to ``shift`` windows, 0 at least.

    Overlaps of fewer than three windows and constant densities count as 0.
    """
    r = densities(ref, ["pair_id"], [window]).select("pair_id", "window", F.col("end_ms").alias("_re"), F.col("counts").alias("r"))
    c = densities(cand, ["pair_id"], [window]).select("pair_id", F.col("end_ms").alias("_ce"), F.col("counts").alias("c"))
    return correlated(r.join(c, "pair_id"), ["pair_id"], shift)


def calibration_scores(ref: DataFrame, cand: DataFrame, windows: list[int], others: int = 8, each: int = 2) -> DataFrame:
    """(kind, window, ref_id, cand_id, cand_no, score): every reference with all candidates of its OWN, and CROSS with the first ``each`` of each of the first ``others`` references.

    cand: pair_id names the reference that a candidate was found for, cand_no which of its candidates it is (0 if there is no such
    column). A stated, small set of other candidates is held against all references. Tracks are reduced to their densities
    before they meet, so no cue is copied for a pair: the few are broadcast, and the own ones meet by reference.
    """
    cand = cand if "cand_no" in cand.columns else cand.withColumn("cand_no", F.lit(0))
    r = densities(ref, ["pair_id"], windows).select(F.col("pair_id").alias("ref_id"), "window", F.col("end_ms").alias("_re"), F.col("counts").alias("r"))

    def found(side: DataFrame) -> DataFrame:
        return densities(side, ["pair_id", "cand_no"], windows).select(F.col("pair_id").alias("cand_id"), "cand_no", F.col("window").alias("_w"), F.col("end_ms").alias("_ce"), F.col("counts").alias("c"))

    first = ref.select("pair_id").distinct().orderBy("pair_id").limit(others)
    place = F.row_number().over(Window.partitionBy("cand_id", "_w").orderBy("cand_no"))
    few = found(cand.join(F.broadcast(first), "pair_id")).withColumn("_p", place).where(F.col("_p") <= each).drop("_p")  # others x each rows a window
    keys = ["kind", "window", "ref_id", "cand_id", "cand_no"]
    met = r.join(F.broadcast(few), (F.col("window") == F.col("_w")) & (F.col("ref_id") != F.col("cand_id"))).withColumn("kind", F.lit("CROSS"))
    own = r.join(found(cand), (F.col("ref_id") == F.col("cand_id")) & (F.col("window") == F.col("_w"))).withColumn("kind", F.lit("OWN"))
    return correlated(met.unionByName(own), keys)


def calibration_summary(scores: DataFrame) -> DataFrame:
    """Least, mean and greatest OWN and CROSS score per window, the gap between them, and the threshold in its middle if there is one."""
    agg = []
    for kind in ("OWN", "CROSS"):
        x = F.when(F.col("kind") == kind, F.col("score"))
        agg += [F.min(x).alias(f"min_{kind.lower()}"), F.avg(x).alias(f"avg_{kind.lower()}"), F.max(x).alias(f"max_{kind.lower()}"), F.count(x).alias(f"n_{kind.lower()}")]
    gap = F.col("min_own") - F.col("max_cross")
    return scores.groupBy("window").agg(*agg).withColumns({"gap": gap, "threshold": F.when(gap > 0, (F.col("min_own") + F.col("max_cross")) / 2)})


# -- alignment -------------------------------------------------------------------------------------


def align_plan(ref: DataFrame, cand: DataFrame, least_ms: int = 150) -> DataFrame:
    """(pair_id, boundary_ms, pre_ms, post_ms) for every pair with cues on both sides; boundary null: one shift (post_ms).

    Without an opening gap in the reference: the global offset. With one, offsets of the parts before and
    after it; where one is missing the other serves. Offsets under ``least_ms`` are noise and become 0.
    """
    return plan_of(both_sides(ref, cand, "cue_no"), least_ms)


def with_gap(both: DataFrame, least: int = 60_000, search: tuple[int, int] = (30_000, 360_000)) -> DataFrame:
    """``both`` with gap_start and gap_end: the reference's opening gap as :func:`op_gap` finds it, on every row of the pair."""
    pair, order = Window.partitionBy("pair_id"), Window.partitionBy("pair_id", "side").orderBy("start_ms", "cue_no")
    gap = F.col("_next") - F.col("end_ms")
    fits = (F.col("side") == 0) & (gap >= least) & F.col("end_ms").between(*search)
    found = F.struct(gap.alias("gap"), (-F.col("start_ms")).alias("s"), (-F.col("cue_no")).alias("c"), F.col("end_ms").alias("gap_start"), F.col("_next").alias("gap_end"))
    marked = both.withColumn("_next", F.lead("start_ms").over(order)).withColumn("_g", F.max(F.when(fits, found)).over(pair))
    return marked.select(*both.columns, F.col("_g.gap_start").alias("gap_start"), F.col("_g.gap_end").alias("gap_end"))


def plan_of(both: DataFrame, least_ms: int = 150) -> DataFrame:
    """:func:`align_plan` of both sides' rows (pair_id, side, start_ms, end_ms, cue_no)."""
    gapped = with_gap(both)
    has = lambda side: F.max(F.col("side") == side).alias(f"_{side}")
    pairs = gapped.groupBy("pair_id").agg(F.max("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end"), has(0), has(1)).where("_0 AND _1")
    # One estimate for all parts: a part has its name and how far it may be moved.
    name = lambda test, x: F.when(test, F.lit(x))
    is_ref, split_up = F.col("side") == 0, F.col("gap_start").isNotNull()
    names = F.array_compact(F.array(name(~split_up, "whole"), name(split_up & (~is_ref | (F.col("end_ms") <= F.col("gap_start"))), "pre"), name(split_up & (~is_ref | (F.col("start_ms") >= F.col("gap_end"))), "post")))
    reach = F.when(F.col("part") == "post", F.col("gap_end") - F.col("gap_start") + 30_000).otherwise(15_000).cast("long")
    parts = gapped.withColumn("part", F.explode(names)).select("pair_id", "part", "side", "start_ms", "end_ms", reach.alias("_ms"))
    offs = offsets(parts, ["pair_id", "part"], 100, F.col("_ms"), F.when(F.col("part") == "whole", 0.4).otherwise(0.2))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("offset_ms")))
    by_pair = offs.groupBy("pair_id").agg(of("whole").alias("whole_ms"), of("pre").alias("_pre"), of("post").alias("_post"))
    found = pairs.join(by_pair, "pair_id", "left")
    found = found.withColumns({"_a": F.coalesce("_pre", "_post"), "_b": F.coalesce("_post", "_pre")})
    solid = lambda x: F.when(F.abs(x) >= least_ms, x).otherwise(0)
    split = F.abs(F.col("_a") - F.col("_b")) >= least_ms
    middle = F.floor((F.col("gap_start") - F.col("_a") + F.col("gap_end") - F.col("_b")) / 2)
    return found.select(
        "pair_id",
        F.when(split, middle).alias("boundary_ms"),
        F.coalesce(F.when(F.col("gap_start").isNull(), solid(F.col("whole_ms"))).when(split, solid(F.col("_a"))).otherwise(solid(F.col("_b"))), F.lit(0)).alias("pre_ms"),
        F.coalesce(F.when(F.col("gap_start").isNull(), solid(F.col("whole_ms"))).otherwise(solid(F.col("_b"))), F.lit(0)).alias("post_ms"),
    )


def shift_of() -> Column:
    """How far a candidate's cue is moved by the plan beside it."""
    return F.coalesce(F.when(F.col("start_ms") < F.col("boundary_ms"), F.col("pre_ms")).otherwise(F.col("post_ms")), F.lit(0))


def apply_shift(cand: DataFrame, plan: DataFrame) -> DataFrame:
    """Candidate cues moved by the plan: those that start before the boundary by pre_ms, the others by post_ms. Pairs without a plan stay."""
    moved = cand.join(plan, "pair_id", "left").withColumn("_d", shift_of())
    return moved.select("pair_id", "cue_no", (F.col("start_ms") + F.col("_d")).alias("start_ms"), (F.col("end_ms") + F.col("_d")).alias("end_ms"), *[c for c in ("text",) if c in cand.columns])


def best_candidates(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Per pair the line-match score before and after alignment, and how far off the candidate is; best first.

    The cues of both sides are shuffled once; the plan and both scores are made where they then lie.
    """
    both = both_sides(ref, cand, "cue_no")
    planned = both.join(plan_of(both), "pair_id")
    moved = F.col("start_ms") + shift_of()
    times = F.when(F.col("side") == 0, F.array("start_ms", "start_ms")).otherwise(F.array(F.col("start_ms"), moved))
    names = ["pair_id", "boundary_ms", "pre_ms", "post_ms"]
    near = nearest_start(planned.select(*names, "side", F.posexplode(times).alias("form", "t")), ["pair_id", "form"])
    matched = lambda form: F.count_if((F.col("form") == form) & F.coalesce(F.col("distance") <= 2000, F.lit(False)))
    scored = near.groupBy(*names).agg((matched(0) / F.count_if(F.col("form") == 0)).alias("score_before"), (matched(1) / F.count_if(F.col("form") == 1)).alias("score_after"))
    return scored.orderBy(F.desc("score_after"), "pair_id")
