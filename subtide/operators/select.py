"""Choosing and auditing tracks and candidates: language and kind rules, selection, manifests, entity columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.operators.cues import NON_DIALOGUE

# Short list of words that mark a track's name as signs and songs when tracks are extracted.
SHORT_SIGNS = ("sign", "song", "op", "ed")
# Track names that say nothing about the kind.
PLAIN_NAMES = ("", "default", "ass", "subtitle", "subtitles")
# File extension by codec; languages by code; kinds of codecs by their beginning.
EXTENSIONS = {"ass": ".ass", "ssa": ".ssa", "subrip": ".srt", "srt": ".srt", "webvtt": ".vtt", "mov_text": ".srt"}
LANGUAGES = {"eng": "en", "en": "en", "und": "en", "pol": "pl", "pl": "pl"}
IMAGE_CODECS = ("hdmv_pgs", "dvd_sub", "dvb_sub", "s_hdmv", "s_vobsub", "pgs", "vobsub")

# Preferred font families, the first before the others.
FONTS = ("DejaVu Sans", "Liberation Sans", "Noto Sans", "Arial", "Helvetica", "Verdana", "Times New Roman")
# Words that mark an entry as no season of a series.
SPECIALS = ("ova", "movie", "film", "special", "bonus", "recap")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def signs_track_name(name: Column) -> Column:
    """The name holds one of the words of NON_DIALOGUE as a word, a plural ``s`` allowed; names that say nothing are dialogue."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return ~low.isin(*PLAIN_NAMES) & low.rlike(rf"\b(?:{'|'.join(NON_DIALOGUE)})s?\b")


def signs_track_short(name: Column) -> Column:
    """The looser rule of track extraction: the name contains one of SHORT_SIGNS anywhere."""
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(SHORT_SIGNS))


def codec_extension(codec: Column) -> Column:
    return F.coalesce(_lookup(EXTENSIONS, F.lower(codec)), F.lit(".srt"))


def language_code(language: Column) -> Column:
    return F.coalesce(_lookup(LANGUAGES, F.lower(language)), F.lower(language))


def codec_kind(codec: Column) -> Column:
    """image for codecs that begin like one of IMAGE_CODECS; anything else, unknown ones too, is text."""
    low = F.lower(F.coalesce(codec, F.lit("")))
    return F.when(low.rlike("^(?:" + "|".join(IMAGE_CODECS) + ")"), "image").otherwise("text")


PROBE = "struct<streams:array<struct<index:int,codec_type:string,codec_name:string,r_frame_rate:string,tags:struct<language:string,title:string,filename:string,mimetype:string>>>,format:struct<tags:struct<title:string>>>"


def explode_streams(probes: DataFrame) -> DataFrame:
    """Subtitle streams of probe documents (media_id, probe JSON): stream_no, subtitle_index among subtitle streams, codec, language (und if none), track_name."""
    streams = probes.select("media_id", F.posexplode(F.from_json("probe", PROBE)["streams"]).alias("pos", "s")).where("s.codec_type = 'subtitle'")
    index = F.row_number().over(Window.partitionBy("media_id").orderBy("pos")) - 1
    return streams.select(
        "media_id", F.coalesce("s.index", "pos").alias("stream_no"), index.alias("subtitle_index"), F.col("s.codec_name").alias("codec"), F.coalesce("s.tags.language", F.lit("und")).alias("language"), F.coalesce("s.tags.title", F.lit("")).alias("track_name")
    )


def probe_facts(probes: DataFrame) -> DataFrame:
    """media_id, title of the container, frames per second of the first video stream, names of attached fonts."""
    p = probes.select("media_id", F.from_json("probe", PROBE).alias("p"))
    video = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))["r_frame_rate"]
    fonts = F.transform(F.filter("p.streams", lambda s: (s["codec_type"] == "attachment") & F.coalesce(s["tags"]["mimetype"].contains("font") | F.lower(s["tags"]["filename"]).rlike(r"\.(ttf|otf|ttc)$"), F.lit(False))), lambda s: s["tags"]["filename"])
    num, den = F.split_part(video, F.lit("/"), F.lit(1)).cast("double"), F.split_part(video, F.lit("/"), F.lit(2)).cast("double")
    return p.select("media_id", F.col("p.format.tags.title").alias("title"), F.try_divide(num, den).alias("fps"), fonts.alias("fonts"))


def english_track(tracks: DataFrame) -> DataFrame:
    """Per media its English dialogue track: the first text one, else the first image one. Media without one are absent."""
    ok = F.lower(F.coalesce("language", F.lit(""))).isin("eng", "en", "und", "") & ~signs_track_name(F.col("track_name"))
    kind = codec_kind(F.col("codec"))
    order = Window.partitionBy("media_id").orderBy(F.when(kind == "text", 0).otherwise(1), "stream_no")
    return tracks.where(ok).withColumns({"kind": kind, "_r": F.row_number().over(order)}).where("_r = 1").drop("_r")


def todo_media(tracks: DataFrame) -> DataFrame:
    """Media without a Polish track."""
    return tracks.select("media_id").distinct().join(tracks.where(F.lower("language").isin("pol", "pl")).select("media_id").distinct(), "media_id", "left_anti")


def new_only(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return found.join(done.select(key), key, "left_anti")


def audit_tracks(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per media: numbers of tracks, whether they and the languages, position by position, are as expected."""
    w = Window.partitionBy("media_id").orderBy("stream_no")
    side = lambda t, name: t.select("media_id", F.row_number().over(w).alias("pos"), F.coalesce("language", F.lit("")).alias(name))
    both = side(actual, "got").join(side(expected, "want"), ["media_id", "pos"], "full")
    return both.groupBy("media_id").agg(F.count("got").alias("n_actual"), F.count("want").alias("n_expected"), F.min(F.coalesce(F.col("got") == F.col("want"), F.lit(False))).alias("languages_equal")).withColumn(
        "ok", (F.col("n_actual") == F.col("n_expected")) & F.col("languages_equal")
    )


def external_subs(media: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries of the same folder and episode as a media, and whether one title holds the other. Rows without an episode or folder match nothing."""
    m = manifest.select(F.col("media_id").alias("manifest_id"), F.col("parsed_title").alias("_t"), "folder", "episode")
    hold = F.lower("parsed_title").contains(F.lower(F.col("_t"))) | F.lower("_t").contains(F.lower(F.col("parsed_title")))
    return media.where("episode IS NOT NULL").join(m, ["folder", "episode"]).select("media_id", "manifest_id", "episode", hold.alias("title_match"))


def english_source(media: DataFrame, fetched: DataFrame, reference: DataFrame, embedded: DataFrame) -> DataFrame:
    """Where each media's English text comes from: fetched, else the reference, else an embedded track; error if nowhere. The three tables: media_id, path."""
    out = media.select("media_id")
    for name, side in (("fetched", fetched), ("reference", reference), ("embedded", embedded)):
        out = out.join(side.select("media_id", F.col("path").alias(name)), "media_id", "left")
    label = F.when(F.col("fetched").isNotNull(), "fetched").when(F.col("reference").isNotNull(), "reference").when(F.col("embedded").isNotNull(), "embedded").otherwise("error")
    return out.select("media_id", F.coalesce("fetched", "reference", "embedded").alias("path"), label.alias("origin"))


def merge_candidates(by_hash: DataFrame, by_query: DataFrame) -> DataFrame:
    """Results of the hash search, and of the text search those whose id that source hasn't given yet; the first of equals by result_no."""
    both = by_hash.withColumn("_p", F.lit(0)).unionByName(by_query.withColumn("_p", F.lit(1)))
    w = Window.partitionBy("media_id", "source", "subtitle_id").orderBy("_p", "result_no")
    kept = both.withColumn("_r", F.row_number().over(w))
    return kept.where("_p = 0 OR _r = 1").drop("_p", "_r")


def ranked_candidates(candidates: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("media_id", "language").orderBy(F.desc("score"), F.desc("hash_match"), "source", "subtitle_id", "result_no"))


def best_per_language(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("_r", ranked_candidates(candidates)).where("_r = 1").drop("_r")


def select_candidates(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """Per media and language the best candidate, and others of a score of at least ``least``, with their rank."""
    return candidates.withColumn("rank", ranked_candidates(candidates)).where((F.col("rank") == 1) | (F.col("score") >= least))


def first_candidates(candidates: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` candidates of each media."""
    w = Window.partitionBy("media_id").orderBy(F.desc("score"), F.desc("hash_match"), "source", "subtitle_id", "result_no")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def provider_score(source: Column, hash_match: Column, similarity: Column) -> Column:
    """A result's score by its provider: similarity (of release names) counts for one of them, 0.7 standing in where it is unknown."""
    return (
        F.when(source == "opensubtitles", F.when(hash_match, 1.0).otherwise(F.coalesce(0.6 + 0.3 * similarity, F.lit(0.7))))
        .when(source == "podnapisi", F.when(hash_match, 0.9).otherwise(0.65)).when(source == "napiprojekt", 0.95).when(source == "animesub", 0.6).otherwise(0.0)
    )


def assemble_tracks(selected: DataFrame, machine: DataFrame, external: DataFrame) -> DataFrame:
    """Output tracks per media in order: selected Polish ones (the first is the default), the machine's (default only if none is selected), external ones."""
    s = selected.select("media_id", F.lit(0).alias("_k"), F.col("rank").cast("long").alias("_o"), F.concat(F.lit("Polish ("), "source", F.lit(")")).alias("title"))
    m = machine.select("media_id", F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit("Polish (AI)").alias("title"))
    e = external.select("media_id", F.lit(2).alias("_k"), F.col("manifest_id").cast("long").alias("_o"), F.lit("External").alias("title"))
    no = F.row_number().over(Window.partitionBy("media_id").orderBy("_k", "_o"))
    return s.union(m).union(e).withColumn("track_no", no).select("media_id", "track_no", "title", ((F.col("track_no") == 1) & (F.col("_k") < 2)).alias("is_default"))


def _either(first: Column, second: Column) -> Column:
    """``first`` unless it is missing: null, 0 or ''."""
    return F.when(first.isNotNull() & ~first.cast("string").isin("", "0"), first).otherwise(second)


def merge_identity(media: DataFrame) -> DataFrame:
    """(media_id, title, parsed_title, year, season, episode, media_type, is_anime, release_group) from what two parsers, the folder and the container say.

    media: media_id, file_name, folder_name, container_title; ani_title, ani_season, ani_episode, ani_year, release_group, is_anime of the parser for
    anime; guess_title, guess_season, guess_episode, guess_year, guess_type of the general one; folder_title, folder_season of the folder's name.
    The anime parser is asked first for anime with a title (season and episode: for anime), the general one otherwise; the year from the
    anime parser first. Without a title the folder's is taken, or its name, and then its season where there is none. 0 and '' are missing where there is
    another to ask. The title is the container's before the parsed one before the file's name.
    """
    c = F.col
    anime = F.coalesce("is_anime", F.lit(False))
    has = lambda x: x.isNotNull() & (x != "")
    parsed = F.when(anime & has(c("ani_title")), c("ani_title")).otherwise(_either(c("guess_title"), c("ani_title")))
    number = lambda n: F.when(anime, _either(c(f"ani_{n}"), c(f"guess_{n}"))).otherwise(_either(c(f"guess_{n}"), c(f"ani_{n}")))
    by_folder = ~has(F.coalesce(parsed, F.lit(""))) & has(F.coalesce("folder_name", F.lit("")))
    made = media.select(
        "media_id", "container_title", "file_name", F.when(by_folder, F.coalesce("folder_title", "folder_name")).otherwise(parsed).alias("parsed_title"), _either(c("ani_year"), c("guess_year")).alias("year"),
        F.when(by_folder, _either(number("season"), c("folder_season"))).otherwise(number("season")).alias("season"), number("episode").alias("episode"), "guess_type", anime.alias("is_anime"), "release_group",
    )
    kind = F.when(c("season").isNotNull() | c("episode").isNotNull() | F.coalesce(c("guess_type") == "episode", F.lit(False)), "episode").otherwise("movie")
    title = _either(c("container_title"), _either(c("parsed_title"), c("file_name")))
    return made.select("media_id", title.alias("title"), "parsed_title", "year", "season", "episode", kind.alias("media_type"), "is_anime", "release_group")


def output_stem(title: Column, season: Column, episode: Column) -> Column:
    """``T - S01E02``, ``T - E02`` or ``T``; of the title letters, digits, blanks, ``-`` and ``_`` stay."""
    t = F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""))
    return F.when(season.isNotNull() & episode.isNotNull(), F.concat(t, F.format_string(" - S%02dE%02d", season, episode))).when(episode.isNotNull(), F.concat(t, F.format_string(" - E%02d", episode))).otherwise(t)


def entry_season(title: Column, base: Column) -> Column:
    """The season that an entry's title names after the base title: 1 if nothing or the episode follows, N for ``SN`` or a bare N, null for SPECIALS and all else."""
    rest = F.when(F.lower(title).startswith(F.lower(base)), F.trim(F.substring(title, F.length(base) + 1, F.length(title)))).otherwise(title)
    low = F.lower(rest)
    number = F.regexp_extract(low, r"^s?(\d+)(?![\p{L}\p{N}_])", 1).try_cast("int")
    return F.when((low == "") | low.startswith("ep"), 1).when(~low.rlike("|".join(SPECIALS)), number)


def entry_matches(title: Column, base: Column, season: Column, episode: Column) -> Column:
    """An entry's title is that of an episode: one of its episode numbers or ranges holds it, and its season is the one asked for; a null season asks for none."""
    low, number = F.lower(title), r"(?:ep|episode\s*|e)(\d+)"
    ranges = F.arrays_zip(*[F.regexp_extract_all(low, F.lit(number + r"\s*-\s*(\d+)"), F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"))])
    in_range = F.exists(ranges, lambda r: episode.between(r["a"].try_cast("int"), r["b"].try_cast("int")))
    single = F.exists(F.regexp_extract_all(low, F.lit(number), F.lit(1)), lambda e: e.try_cast("int") == episode)
    return (in_range | single) & (season.isNull() | F.coalesce(entry_season(title, base) == season, F.lit(False)))


def pick_font(styles: DataFrame, fonts: DataFrame, required: str) -> DataFrame:
    """Per media and style font the file to use: one whose stem begins with its name, else with that of a preferred family, else any; all must have every letter of ``required``.

    styles: media_id, fontname; fonts: stem, letters (array of characters). ``-`` and ``_`` count as blanks;
    ties go to the stem that sorts first. A stem has one row for each length that a name has, and meets names of that length
    that are its beginning, so no more rows meet than fit. Media without any font are absent; null names get a preferred family.
    """
    need = F.array(*[F.lit(c) for c in required])
    plain = lambda c: F.lower(F.translate(c, "-_", "  "))
    good = fonts.where(F.size(F.array_except(need, "letters")) == 0).select("stem", plain(F.col("stem")).alias("_s"))
    wanted = styles.select("media_id", "fontname").distinct()
    names = wanted.select("fontname").distinct().withColumn("_n", plain(F.col("fontname"))).where("_n <> ''")
    lengths = names.agg(F.collect_set(F.length("_n")).alias("_l"))  # one row, of as many numbers as the longest name has letters at most
    heads = good.join(F.broadcast(lengths), how="cross").select("stem", F.explode(F.transform(F.filter("_l", lambda n: n <= F.length("_s")), lambda n: F.substring(F.col("_s"), F.lit(1), n))).alias("_n"))
    own = names.join(heads, "_n").groupBy("fontname").agg(F.min("stem").alias("own"))
    place = F.coalesce(*[F.when(F.col("_s").startswith(name.lower()), i) for i, name in enumerate(FONTS)], F.lit(len(FONTS)))
    spare = good.agg(F.min(F.struct(place.alias("p"), "stem")).alias("spare")).select("spare.stem")  # one row
    picked = wanted.join(own, "fontname", "left").join(F.broadcast(spare.select(F.col("stem").alias("spare"))), how="cross")
    return picked.select("media_id", "fontname", F.coalesce("own", "spare").alias("stem")).where("stem IS NOT NULL")


def embedded_font_covers(embedded: DataFrame, required: str) -> DataFrame:
    """(media_id, covered): whether any font attached to a media has every letter of ``required``. embedded: media_id, letters."""
    need = F.array(*[F.lit(c) for c in required])
    return embedded.groupBy("media_id").agg(F.max(F.coalesce(F.size(F.array_except(need, "letters")) == 0, F.lit(False))).alias("covered"))


def build_manifest(tracks: DataFrame) -> DataFrame:
    """(media_id, doc): one JSON document per media with its tracks in stream order."""
    t = F.struct("stream_no", F.concat(F.col("stream_no").cast("string"), codec_extension(F.col("codec"))).alias("file"), language_code(F.col("language")).alias("language"))
    return tracks.groupBy("media_id").agg(F.array_sort(F.collect_list(t)).alias("subtitles")).select("media_id", F.to_json(F.struct("subtitles")).alias("doc"))
