"""Parallel pairs as training records: context strings, dialogue windows, checks, splits.

Pairs: show_id, episode_id, pair_no, english, polish. Shows: show_id and tag columns. Characters, events and terms have rows of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The controlled vocabularies of show tags.
VOCABULARY = {
    "genre": "action adventure comedy crime dark_fantasy drama fantasy historical horror isekai mecha mystery psychological romance sci_fi slice_of_life sports supernatural thriller war".split(),
    "tone": "neutral lighthearted humorous sarcastic dramatic grim melancholic tense whimsical epic intimate".split(),
    "setting": "contemporary historical_european medieval_european historical_japanese feudal_japanese futuristic post_apocalyptic fantasy_world urban rural space school military supernatural".split(),
    "audience": "children teen young_adult adult mature".split(),
}


def vocabulary_errors(shows: DataFrame) -> DataFrame:
    """(show_id, field, value) of every tag outside its vocabulary. Tag columns are arrays; null ones are fine."""
    out = None
    for field, allowed in VOCABULARY.items():
        wrong = shows.select("show_id", F.lit(field).alias("field"), F.explode(F.array_except(field, F.array(*[F.lit(v) for v in allowed]))).alias("value"))
        out = wrong if out is None else out.union(wrong)
    return out


def context_strings(shows: DataFrame, events: DataFrame, characters: DataFrame, terms: DataFrame) -> DataFrame:
    """(show_id, context): tags, events, characters (name:traits) and terms (en=pl), parted by `` | ``; empty sections are left out."""
    listed = lambda df, sep, col: df.groupBy("show_id").agg(F.array_join(F.array_sort(F.collect_set(col)), sep).alias("x"))
    tags = [F.when(F.size(f) > 0, F.concat(F.lit(f"{f}:"), F.array_join(f, ","))) for f in VOCABULARY]
    base = shows.select("show_id", F.array_join(F.filter(F.array(*tags), lambda t: t.isNotNull()), " ").alias("_tags"))
    for name, df in (("_events", listed(events, ",", F.col("event"))), ("_people", listed(characters, " ", F.concat_ws(":", "name", "traits"))), ("_terms", listed(terms, " ", F.concat_ws("=", "english", "polish")))):
        base = base.join(df.withColumnRenamed("x", name), "show_id", "left")
    sections = F.filter(F.array("_tags", "_events", "_people", "_terms"), lambda s: F.coalesce(s, F.lit("")) != "")
    return base.select("show_id", F.array_join(sections, " | ").alias("context"))


def dialogue_window(pairs: DataFrame, n: int = 2) -> DataFrame:
    """``pairs`` with dialogue_prev and dialogue_next: up to ``n`` English lines on either side within the episode; null lines are empty ones."""
    english = F.coalesce("english", F.lit(""))
    order = Window.partitionBy("show_id", "episode_id").orderBy("pair_no")
    return pairs.withColumns({"dialogue_prev": F.collect_list(english).over(order.rowsBetween(-n, -1)), "dialogue_next": F.collect_list(english).over(order.rowsBetween(1, n))})


def pair_issues(english: Column, polish: Column, names: list[str], least: float = 0.4, most: float = 2.5) -> Column:
    """Labels of a pair: length ratio out of bounds, an English word kept, a name lost."""
    ratio = F.length(polish) / F.nullif(F.length(english), F.lit(0))
    # A word: letters, digits and underscores with none beside them. No lambdas, which would keep Spark from sharing what labels have in common.
    word = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"), F.lit(0))
    low, other = [n.lower() for n in names], F.lower(polish)
    both = F.array_intersect(word(english), word(polish))
    kept = F.size(F.array_except(both, F.array(*[F.lit(n) for n in low])) if low else both) > 0
    lost = reduce(lambda a, n: a | (F.contains(F.lower(english), F.lit(n)) & ~F.contains(other, F.lit(n))), low, F.lit(False))
    labels = F.array(F.when((ratio < least) | (ratio > most), F.lit("length")), F.when(kept, F.lit("untranslated")), F.when(lost, F.lit("name")))
    return F.array_except(labels, F.array(F.lit(None).cast("string")))


def is_validation(episode_id: Column, of: int = 10) -> Column:
    """Whole episodes are held out: one of ``of`` by a hash of the id."""
    return F.pmod(F.crc32(episode_id.cast("string").cast("binary")), F.lit(of)) == 0


def training_export(pairs: DataFrame, contexts: DataFrame, n: int = 2) -> DataFrame:
    """Flat records: source, target, context, dialogue_prev, dialogue_next, and whether they are for validation."""
    return dialogue_window(pairs, n).join(contexts, "show_id", "left").select(
        "episode_id", "pair_no", F.col("english").alias("source"), F.col("polish").alias("target"), F.coalesce("context", F.lit("")).alias("context"), "dialogue_prev", "dialogue_next", is_validation(F.col("episode_id")).alias("is_validation")
    )


def split_stats(records: DataFrame) -> DataFrame:
    """Records and episodes of either side of the split."""
    return records.groupBy("is_validation").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("episode_id").alias("episodes"))


def write_export(records: DataFrame, path: str) -> None:
    """JSON lines in a folder each for training and validation."""
    for name, side in (("train", ~F.col("is_validation")), ("val", F.col("is_validation"))):
        records.where(side).drop("is_validation", "episode_id", "pair_no").write.json(f"{path}/{name}")
