"""Translation units: grouping lines into sentences, joining them for a translator, dealing results back; names worth protecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.functions.text import ELLIPSIS, SPEAKER, TERMINAL, strip_pipes
from subtide.operators.cues import stripped, stripped_column

MAX_LINES = 3
MAX_WORDS = 60
SHORT_WORDS = 3

# Titles before names, and capitalised words that are no names.
HONORIFICS = ("Sir", "Lord", "Lady", "Princess", "Prince", "King", "Queen", "Master", "Miss")
NO_NAMES = (
    "The This That What When Where Which Who How Why But And Yet For Nor Not Now Yes Hey Well Look Come Here There Big Old New Good Bad Great Little "
    "Never Always Perhaps Maybe Please Sorry Damn Hell God Idiot Fool Bastard Women Men Indeed However Besides Supposedly Being Those Such Some Get Let"
).split()


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.when(text.rlike(r"[\t\n\x0B\f\r]"), F.translate(text, "\t\n\x0b\f\r", " " * 5)).otherwise(text), " "), ""))


def group_units(cues: DataFrame) -> DataFrame:
    """(track_id, unit_no, cue_nos, is_fragment_merge): every line in exactly one unit, in order.

    A line joins the one before it if neither is a speaker line, the one before doesn't end a sentence,
    and it isn't a capitalised line after an ellipsis. Of the lines left alone, complete ones of more than
    SHORT_WORDS words are batched in order, up to MAX_LINES lines and MAX_WORDS words.
    """
    return _units(cues, with_text=False).select("track_id", "unit_no", F.col("lines.cue_no").alias("cue_nos"), "is_fragment_merge")


def whole_units(cues: DataFrame) -> DataFrame:
    """(track_id, unit_no, is_fragment_merge, lines): the units of :func:`group_units` with their lines' numbers, words (``w``, one at least) and part of the input (``p``).

    Lines are shuffled once, by track; what is asked of a unit (:func:`inputs_of`, :func:`dealt`) is made where it lies.
    """
    return _units(cues, with_text=True)


def _units(cues: DataFrame, with_text: bool) -> DataFrame:
    order = Window.partitionBy("track_id").orderBy("cue_no")
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    s, first, last = F.col("_t"), F.substring("_t", 1, 1), F.substring("_t", -1, 1)
    text = cues.select("track_id", "cue_no", F.coalesce("text", F.lit("")).alias("text"))
    # Nothing follows the last character of a stripped line, so it tells most lines; the patterns only see what they can fit.
    dots = F.contains(s, F.lit("..")) & s.rlike(ELLIPSIS)
    mark = last.isin(*".!?") | (last.isin(*"\"')»]") & s.rlike(TERMINAL))
    flags = text.withColumns({"_t": stripped_column("text"), "_words": word_count(F.col("text"))}).withColumns({"_dots": dots, "_mark": mark, "_speaker": first.isin(*"-—–") & s.rlike(SPEAKER)})
    flags = flags.withColumn("_end", F.col("_mark") & ~F.col("_dots"))
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    joins = ~F.col("_speaker") & ~before("_speaker") & ~before("_end") & ~(before("_dots") & capital)
    marked = flags.withColumn("_new", ~F.coalesce(joins, F.lit(False)))
    marked = marked.withColumn("_last", F.coalesce(after("_new"), F.lit(True)))
    alone = F.col("_new") & F.col("_last")
    marked = marked.withColumn("_long", alone & F.col("_end") & ~F.col("_speaker") & (F.col("_words") > SHORT_WORDS))
    marked = marked.withColumn("_merge", ~F.col("_long") & ~F.col("_speaker") & ~(alone & F.col("_end")))
    # Groups of lines: islands, and runs of long lines, cut where two never fit into one unit.
    fits = F.coalesce(before("_long"), F.lit(False)) & (before("_words") + F.col("_words") <= MAX_WORDS)
    fields = {"w": F.greatest("_words", F.lit(1))}
    if with_text:
        fields["p"] = F.when(F.col("_merge"), stripped_column("_p")).otherwise(F.col("text"))
        marked = marked.withColumn("_p", _without_seams(F.when(F.col("_merge") & ~F.col("_new"), before("_t")), F.when(F.col("_merge") & ~F.col("_last"), after("_t"))))
    marked = marked.withColumns({"_edge": F.when(F.when(F.col("_long"), ~fits).otherwise(F.col("_new")), 1).otherwise(0), **fields}).withColumn("_group", F.sum("_edge").over(order))
    groups = marked.groupBy("track_id", "_group").agg(
        F.sort_array(F.collect_list(F.struct("cue_no", *fields))).alias("lines"), F.first("_merge").alias("is_fragment_merge"), F.first("_long").alias("_long"), F.max("_words").alias("_most")
    )
    n = F.size("lines")
    # Lines that fit by threes whatever they are need no fold. Fold: (lines and words of the unit so far, number of the line, first lines of units)
    start = F.expr("named_struct('n', 0, 'w', 0, 'i', 0, 'all', CAST(array() AS ARRAY<INT>))")

    def step(a, w):
        full = (a["n"] == 0) | (a["n"] == MAX_LINES) | (a["w"] + w > MAX_WORDS)
        return F.when(full, F.struct(F.lit(1).alias("n"), w.alias("w"), (a["i"] + 1).alias("i"), F.concat(a["all"], F.array(a["i"])).alias("all"))).otherwise(
            F.struct((a["n"] + 1).alias("n"), (a["w"] + w).alias("w"), (a["i"] + 1).alias("i"), a["all"].alias("all"))
        )

    folded = F.aggregate(F.col("lines.w"), start, step, lambda a: a["all"])
    starts = F.when(~F.col("_long") | (n == 1), F.array(F.lit(0))).when(F.col("_most") * MAX_LINES <= MAX_WORDS, F.sequence(F.lit(0), n - 1, F.lit(MAX_LINES))).otherwise(folded)
    cut = F.transform("_starts", lambda at, i: F.slice("lines", at + 1, F.coalesce(F.get("_starts", i + 1), n) - at))
    pieces = F.when(F.size("_starts") == 1, F.array("lines")).otherwise(cut)
    units = groups.withColumn("_starts", starts).select("track_id", "is_fragment_merge", F.explode(pieces).alias("lines"))
    no = F.row_number().over(Window.partitionBy("track_id").orderBy(F.col("lines")[0]["cue_no"])) - 1
    return units.select("track_id", no.alias("unit_no"), "is_fragment_merge", "lines")


def _without_seams(before: Column, after: Column) -> Column:
    """The column ``text`` without the pair of ellipses at a seam with the stripped lines ``before`` and ``after`` it."""
    text = F.col("text")
    tail = F.when(after.startswith("."), F.regexp_replace(text, r"\s*\.{2,}$", "")).otherwise(text)
    return F.when(before.endswith("."), F.regexp_replace(tail, r"^\.{2,}\s*", "")).otherwise(tail)


def _with_lines(cues: DataFrame, units: DataFrame) -> DataFrame:
    """:func:`whole_units` of units that are there already (track_id, unit_no, cue_nos, is_fragment_merge)."""
    order = Window.partitionBy("track_id", "unit_no").orderBy("place")
    placed = units.select("track_id", "unit_no", "is_fragment_merge", F.posexplode("cue_nos").alias("place", "cue_no"))
    lines = cues.select("track_id", "cue_no", F.coalesce("text", F.lit("")).alias("text")).join(placed, ["track_id", "cue_no"]).withColumn("_t", stripped_column("text"))
    part = F.when(F.col("is_fragment_merge"), stripped(_without_seams(F.lag("_t").over(order), F.lead("_t").over(order)))).otherwise(F.col("text"))
    line = F.struct("place", "cue_no", F.greatest(word_count(F.col("text")), F.lit(1)).alias("w"), F.col("_p").alias("p"))
    return lines.withColumn("_p", part).groupBy("track_id", "unit_no", "is_fragment_merge").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def inputs_of(units: DataFrame) -> DataFrame:
    """``units`` of :func:`whole_units` with ``input``: fragments joined by a space, other lines by `` || ``."""
    p = F.col("lines.p")
    return units.withColumn("input", F.when(F.col("is_fragment_merge"), F.array_join(p, " ")).otherwise(F.array_join(p, " || ")))


def build_input(cues: DataFrame, units: DataFrame) -> DataFrame:
    """(track_id, unit_no, input): fragments joined by a space, without the pair of ellipses at a seam; other lines joined by `` || ``."""
    return inputs_of(_with_lines(cues, units)).select("track_id", "unit_no", "input")


def split_output(cues: DataFrame, units: DataFrame, outputs: DataFrame) -> DataFrame:
    """(track_id, cue_no, text): each unit's ``output`` (track_id, unit_no, output) dealt back to its lines as by :func:`dealt`."""
    return dealt(_with_lines(cues, units).join(outputs.select("track_id", "unit_no", "output"), ["track_id", "unit_no"]))


def dealt(units: DataFrame) -> DataFrame:
    """(track_id, cue_no, text): the ``output`` of each of ``units`` (with ``lines`` of cue_no and w, and is_fragment_merge) dealt back to its lines.

    Batches are cut at ``||`` where the number of parts is right. Else words are shared out in proportion to
    the lines' words: rounded half to even, one at least where there is one, one left for each line to come,
    the rest to the last.
    """
    out = units.select("track_id", "is_fragment_merge", F.col("lines.cue_no").alias("_nos"), F.col("lines.w").alias("_w"), F.coalesce("output", F.lit("")).alias("_o"))
    # Step by step, each from columns before; what a unit doesn't need stays null: a line alone takes all, and where parts are right no words are shared.
    n, several = F.size("_nos"), F.size("_nos") > 1
    out = out.withColumn("_flat", F.when(F.contains("_o", F.lit("|")), strip_pipes(F.col("_o"))).otherwise(stripped_column("_o"))).withColumn("_parts", F.when(several & ~F.col("is_fragment_merge"), F.transform(F.split("_o", r"\|\|"), lambda p: strip_pipes(p))))
    shares = several & ~F.coalesce(F.size("_parts") == n, F.lit(False))
    out = out.withColumn("_words", F.when(shares, F.filter(F.split("_flat", r"\s+"), lambda w: w != "")))
    out = out.withColumns({"_total": F.size("_words"), "_sum": F.when(F.col("_words").isNotNull(), F.aggregate(F.col("_w"), F.lit(0), lambda a, x: a + x))})
    start = F.expr("named_struct('used', 0, 'left', size(_nos), 'ends', CAST(array() AS ARRAY<INT>))")

    def step(a, w):
        to_come, words_left = a["left"] - 1, F.col("_total") - a["used"]
        share = F.greatest(F.rint(w / F.col("_sum") * F.col("_total")).cast("int"), F.least(F.lit(1), words_left))
        share = F.when(to_come == 0, words_left).otherwise(F.least(share, F.greatest(F.lit(0), words_left - to_come)))
        return F.struct((a["used"] + share).alias("used"), to_come.alias("left"), F.concat(a["ends"], F.array(a["used"] + share)).alias("ends"))

    out = out.withColumn("_ends", F.when(F.col("_words").isNotNull(), F.aggregate(F.col("_w"), start, step, lambda a: a["ends"])))
    low = lambda i: F.when(i == 0, 0).otherwise(F.get("_ends", i - 1))
    shared = F.transform("_ends", lambda e, i: F.array_join(F.slice("_words", low(i) + 1, e - low(i)), " "))
    texts = F.when(~several, F.array("_flat")).when(F.col("_words").isNull(), F.col("_parts")).otherwise(shared)
    return out.select("track_id", F.explode(F.arrays_zip(F.col("_nos").alias("cue_no"), texts.alias("text"))).alias("_z")).select("track_id", "_z.cue_no", "_z.text")


def context_window(cues: DataFrame, n: int = 2) -> DataFrame:
    """(track_id, cue_no, context, own): lines within ``n`` of each, joined by `` ||| ``, and the line picked back out.

    A null line is an empty one in the context. The line is picked from the window, not from the joined
    text, so a line that holds the separator is none the worse.
    """
    order = Window.partitionBy("track_id").orderBy("cue_no")
    near = F.collect_list(F.coalesce("text", F.lit(""))).over(order.rowsBetween(-n, n))
    at = F.least(F.row_number().over(order) - 1, F.lit(n))
    return cues.select("track_id", "cue_no", near.alias("_near"), at.alias("_at")).select("track_id", "cue_no", F.array_join("_near", " ||| ").alias("context"), F.get("_near", F.col("_at")).alias("own"))


def proper_nouns(cues: DataFrame, least: int = 3) -> DataFrame:
    """(track_id, name, votes): words likely to be names, by votes.

    Five after a title, two before ``,!?``, three for a line that is nothing else, one inside a line.
    """
    text = F.col("text")
    # What is counted as a name, and for how much.
    votes = [
        (5, F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(HONORIFICS)})\s+([A-Z][a-z]+)"), F.lit(1))),
        (2, F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,})[,!?]"), F.lit(1))),
        (3, F.regexp_extract_all(stripped(F.regexp_replace(stripped(text), r"[!?.]+$", "")), F.lit(r"^([A-Z][a-z]+)$"), F.lit(1))),
        (1, F.filter(F.transform(F.filter(F.split(stripped(text), r"\s+"), lambda w, i: i > 0), lambda w: F.regexp_replace(w, r"^[.,!?;:\"'-]+|[.,!?;:\"'-]+$", "")), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))),
    ]

    def weighted(v: int, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(v).alias("v")))

    all_votes = F.flatten(F.array(*[weighted(v, names) for v, names in votes]))
    counted = cues.where("text IS NOT NULL").select("track_id", F.explode(all_votes).alias("x")).groupBy("track_id", "x.name").agg(F.sum("x.v").alias("votes"))
    return counted.where((F.col("votes") >= least) & ~F.col("name").isin([*NO_NAMES, *HONORIFICS]))
