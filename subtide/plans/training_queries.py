"""Queries over parallel pairs, made from the lines, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from subtide.functions.text import rewrite_idioms
from subtide.operators import training as t
from subtide.plans.text_queries import _idioms
from subtide.sources import adapters as a


def _pairs(s, d):
    x = a.text_lines(s, d)
    return x.select((F.col("track_id") % 20).alias("show_id"), F.col("track_id").alias("episode_id"), F.col("cue_no").alias("pair_no"), F.col("text").alias("english"), F.upper(rewrite_idioms(F.col("text"))).alias("polish"))


def _shows(s, d):
    g = F.array(F.element_at(F.array(F.lit("action"), F.lit("grim"), F.lit("war")), (F.col("media_id") % 3 + 1).cast("int")))
    return a.media(s, d).select(F.col("media_id").alias("show_id"), g.alias("genre"), F.array(F.lit("epic")).alias("tone"), F.when(F.col("season").isNotNull(), F.array(F.lit("urban"))).alias("setting"), F.lit(None).cast("array<string>").alias("audience"))


def _contexts(s, d):
    m = a.media(s, d).withColumnRenamed("media_id", "show_id")
    events = m.where("episode % 2 = 0").select("show_id", F.lit("battle").alias("event"))
    people = m.select("show_id", F.split_part("parsed_title", F.lit(" "), F.lit(1)).alias("name"), F.lit("m/formal").alias("traits"))
    terms = m.where("episode % 5 = 0").select("show_id", F.lit("Sword").alias("english"), F.lit("Miecz").alias("polish"))
    return t.context_strings(_shows(s, d), events, people, terms)


def _records(s, d):
    return t.training_export(_pairs(s, d), _contexts(s, d))


QUERIES = {
    "d1_training_export": lambda s, d: _records(s, d).withColumns({c: F.array_join(c, " / ") for c in ("dialogue_prev", "dialogue_next")}),
    "d2_split_stats": lambda s, d: t.split_stats(_records(s, d)),
    "d3_context_strings": _contexts,
    "d4_vocabulary_errors": lambda s, d: t.vocabulary_errors(_shows(s, d)),
    "d5_pair_issues": lambda s, d: _pairs(s, d).select("episode_id", "pair_no", F.array_join(t.pair_issues(F.col("english"), F.col("polish"), ["there"]), " ").alias("issues")),
    "d6_dialogue_window": lambda s, d: t.dialogue_window(_pairs(s, d)).select("episode_id", "pair_no", F.array_join("dialogue_prev", " / ").alias("prev"), F.array_join("dialogue_next", " / ").alias("next")),
}

CTX = """ctx AS (SELECT media_id AS show_id, 'genre:' || ['action', 'grim', 'war'][media_id % 3 + 1] || ' tone:epic' || CASE WHEN season IS NOT NULL THEN ' setting:urban' ELSE '' END
  || CASE WHEN episode % 2 = 0 THEN ' | battle' ELSE '' END || ' | ' || split_part(parsed_title, ' ', 1) || ':m/formal' || CASE WHEN episode % 5 = 0 THEN ' | Sword=Miecz' ELSE '' END AS context FROM media)"""
# CRC-32 bit by bit. Fixed value: its polynomial, reversed.
_BIT = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"
SPLIT = """bits AS (SELECT DISTINCT track_id, [c for c in string_split(track_id::VARCHAR, '') if c <> ''] AS ds FROM lines),
crc AS (SELECT track_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(ds, lambda c: ascii(c)::BIGINT)), lambda a, b: STEPS), 4294967295) % 10 = 0 AS is_validation FROM bits)"""
# The eight steps of a byte, each on the list's last number.
SPLIT = SPLIT.replace("STEPS", "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: " + _BIT.format("v") + ")")
NEAR = "coalesce(array_to_string(list(text) OVER (PARTITION BY track_id ORDER BY cue_no ROWS BETWEEN {}), ' / '), '')"
RECORDS = f"""{SPLIT}, {CTX}, rec AS (SELECT track_id AS episode_id, cue_no AS pair_no, text AS source, upper(replace({_idioms('text')}, 'ß', 'ss')) AS target, coalesce(context, '') AS context,
  {NEAR.format('2 PRECEDING AND 1 PRECEDING')} AS dialogue_prev, {NEAR.format('1 FOLLOWING AND 2 FOLLOWING')} AS dialogue_next, is_validation FROM lines JOIN crc USING (track_id) LEFT JOIN ctx ON show_id = track_id % 20)"""
WORDS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$'))"
ORACLES = {
    "d1_training_export": a.with_views("lines media", f", {RECORDS} SELECT * FROM rec"),
    "d2_split_stats": a.with_views("lines media", f", {RECORDS} SELECT is_validation, count(*) AS pairs, count(DISTINCT episode_id) AS episodes FROM rec GROUP BY is_validation"),
    "d5_pair_issues": a.with_views("lines", f""", p AS (SELECT track_id AS episode_id, cue_no AS pair_no, text AS e, upper(replace({_idioms('text')}, 'ß', 'ss')) AS o FROM lines), q AS (SELECT *, length(o)::DOUBLE / nullif(length(e), 0) AS ratio FROM p)
SELECT episode_id, pair_no, array_to_string(list_filter([CASE WHEN ratio < 0.4 OR ratio > 2.5 THEN 'length' END, CASE WHEN len(list_filter(list_intersect({WORDS.format('e')}, {WORDS.format('o')}), lambda w: w <> 'there')) > 0 THEN 'untranslated' END,
  CASE WHEN contains(lower(e), 'there') AND NOT contains(lower(o), 'there') THEN 'name' END], lambda x: x IS NOT NULL), ' ') AS issues FROM q"""),
    "d3_context_strings": a.with_views("media", f", {CTX} SELECT * FROM ctx"),
    "d4_vocabulary_errors": a.with_views("media", " SELECT media_id AS show_id, 'genre' AS field, 'grim' AS value FROM media WHERE media_id % 3 = 1"),
    "d6_dialogue_window": a.with_views("lines", """ SELECT track_id AS episode_id, cue_no AS pair_no, coalesce(array_to_string(list(text) OVER (PARTITION BY track_id ORDER BY cue_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' / '), '') AS prev,
  coalesce(array_to_string(list(text) OVER (PARTITION BY track_id ORDER BY cue_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' / '), '') AS "next" FROM lines"""),
}
