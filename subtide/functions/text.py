"""Text rules as column expressions: phrases, idioms, fixes after translation, sentence tests, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subtide.operators.cues import SPACES, stripped, trimmed

# Polish letters and their ASCII stand-ins.
POLISH, ASCII = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"

# Dictionary answers of one word.
WORDS = {
    "yes": "tak", "no": "nie", "maybe": "może", "wait": "czekaj", "stop": "stop", "go": "idź", "help": "pomocy", "please": "proszę", "thanks": "dzięki",
    "sorry": "przepraszam", "okay": "dobrze", "ok": "ok", "fine": "dobrze", "sure": "jasne", "never": "nigdy", "always": "zawsze", "hello": "cześć", "hi": "cześć",
    "bye": "pa", "goodbye": "do widzenia", "huh": "co", "what": "co", "right": "racja", "really": "naprawdę", "seriously": "poważnie", "exactly": "dokładnie",
    "understood": "zrozumiałem", "impossible": "niemożliwe", "damn": "cholera", "dunno": "nie wiem", "yo": "hej", "hey": "hej", "listen": "słuchaj", "look": "patrz",
    "run": "uciekaj", "enough": "wystarczy", "idiot": "idioto", "liar": "kłamca", "unbelievable": "niewiarygodne", "march": "naprzód", "charge": "do ataku",
}
# Dictionary answers of several words.
PHRASES = {
    "thank you": "dziękuję", "i see": "rozumiem", "i know": "wiem", "of course": "oczywiście", "excuse me": "przepraszam", "good luck": "powodzenia", "come on": "no dalej",
    "no way": "nie ma mowy", "damn it": "cholera", "what the hell": "co do cholery", "got it": "rozumiem", "hold on": "chwileczkę", "not at all": "wcale nie",
    "no doubt": "bez dwóch zdań", "give me a break": "daj spokój", "shut up": "zamknij się", "how dare you": "jak śmiesz", "calm down": "spokojnie", "let me go": "puść mnie",
    "you idiot": "ty idioto", "are you okay": "wszystko dobrze", "good morning": "dzień dobry", "good night": "dobranoc", "way to go": "tak trzymaj",
    "get it together": "weź się w garść", "son of a bitch": "sukinsyn",
}
# Idioms and their plain wording, applied in this order.
IDIOMS = [
    ("break a leg", "good luck"), ("raining cats and dogs", "raining heavily"), ("piece of cake", "very easy"), ("hit the nail on the head", "exactly right"),
    ("let the cat out of the bag", "reveal a secret"), ("once in a blue moon", "very rarely"), ("under the weather", "feeling sick"), ("spill the beans", "reveal a secret"),
    ("barking up the wrong tree", "looking in the wrong place"), ("cost an arm and a leg", "very expensive"),
]
# Translations known to be wrong (pattern, replacement), applied in this order.
FIXES = [
    (r"(?U)\bMarzec\b", "Naprzód"), (r"(?iU)\bDobra droga\b", "Tak trzymaj"), (r"^Ładuj!$", "Do ataku!"), (r"(?iU)\bstrajk\b", "cios"), (r"(?iU)Weź to razem", "Weź się w garść"),
]

# What a text has if fix_translation changes it, a pattern of RE2 (pyarrow). A part of each of FIXES, in letters that no other letter is
# a case of; dashes, marks and white space as the rules after them need them.
MENDABLE = rf"\A[{SPACES}-]|[{SPACES}]\z|[{SPACES}][.!?]|\.\.|!!|\?\?|\A[^\s,]+,[^,]+[.!?]\z|Marzec|Ładuj!|(?i:dobra droga|trajk| to razem)"
MARKS = ".!?,;:…"

TERMINAL = r"[.!?][\"')»\]]*\s*$"
ELLIPSIS = r"\.{2,}[\"')»\]]*\s*$"
SPEAKER = r"^[\-—–]\s*\S"
TAG_ONLY = r"^\W*__[A-Z]{2}\d+__\W*$"


def replace_polish(text: Column) -> Column:
    return F.translate(text, POLISH, ASCII)


def normalize_phrase(text: Column) -> dict[str, Column]:
    """base (lower-cased, without the run of punctuation at the end), punct and cap (UPPER, Title or lower) of a line.

    A line with a line break inside keeps its punctuation.
    """
    s = stripped(text)
    base = _base(s)
    return {"base": F.lower(base), "punct": _punct(s), "cap": _cap(base)}


def _whole(s: Column) -> Column:
    return ~F.contains(s, F.lit("\n"))


def _punct(s: Column) -> Column:
    return F.when(_whole(s), F.regexp_extract(s, rf"([{MARKS}]+)$", 1)).otherwise("")


def _base(s: Column) -> Column:
    return F.when(_whole(s), trimmed(F.rtrim(s, F.lit(MARKS)))).otherwise(s)


def _cap(base: Column) -> Column:
    first = F.substring(base, 1, 1)
    upper = (F.upper(base) == base) & (F.lower(base) != base)
    title = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(upper, "UPPER").when(title, "Title").otherwise("lower")


def apply_formatting(text: Column, punct: Column, cap: Column) -> Column:
    titled = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    return F.concat(F.when(cap == "UPPER", F.upper(text)).when(cap == "Title", titled).otherwise(text), punct)


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """``rules`` (pattern, replacement) applied in order; one look for any of them leaves out the others where there is none."""
    return F.when(text.rlike("|".join(f"(?:{p})" for p, _ in rules)), reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), rules, text)).otherwise(text)


def rewrite_idioms(text: Column) -> Column:
    any_of = rf"(?iU)\b(?:{'|'.join(p for p, _ in IDIOMS)})\b"
    return F.when(text.rlike(any_of), reduce(lambda t, p: F.regexp_replace(t, rf"(?iU)\b{p[0]}\b", p[1]), IDIOMS, text)).otherwise(text)


def fix_translation(text: Column) -> Column:
    """Strips, applies FIXES, and undoes doubled dialogue lines, ``X, X!``, repeated marks and spaces before marks."""
    t = reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), FIXES, stripped(text))
    # Dialogue lines that say the same twice.
    bang, mark = r"(?iU)^-\s*([^-]+?)\s*!\s*-\s*\1\s*!$", r"(?iU)^-\s*([^-]+?)\s*[.?!]\s*-\s*\1\s*([.?!])$"
    t = F.regexp_replace(F.regexp_replace(t, bang, "$1!"), mark, "$1$2")  # what the first makes begins with no dash, so the second passes it; t is written once, so it is made once
    t = F.regexp_replace(t, r"(?iU)^(\w+),\s*\1([.!?])$", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, r"([.!?])\1+", "$1"), r"(?U)\s+([.!?])", "$1")


def ends_with_ellipsis(text: Column) -> Column:
    return stripped(text).rlike(ELLIPSIS)


def is_sentence_end(text: Column) -> Column:
    """Ends in ``.!?`` and closing quotes, but not in an ellipsis."""
    return ends_sentence(stripped(text))


def ends_sentence(s: Column) -> Column:
    """The same of a text that is stripped already."""
    return s.rlike(TERMINAL) & ~s.rlike(ELLIPSIS)


def is_speaker_line(text: Column) -> Column:
    return stripped(text).rlike(SPEAKER)


def strip_pipes(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s*\|+\s*", " "))


def placeholder_only(text: Column) -> Column:
    """The line is one placeholder tag and punctuation."""
    return stripped(text).rlike(TAG_ONLY)


def fallback_guard(original: Column, out: Column) -> Column:
    """The original where the translation is blank, or under two characters for an original of over five."""
    t, o = trimmed(out), trimmed(original)
    return F.when(F.coalesce(t, F.lit("")) == "", original).when((F.length(t) < 2) & (F.length(o) > 5), original).otherwise(out)


def release_tokens(name: Column) -> Column:
    """Distinct lower-case parts of a release name."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[.\-_ \[\]()]+"), lambda x: x != ""))


def release_score(a: Column, b: Column) -> Column:
    """Jaccard similarity of two names' tokens; 0 if either has none."""
    x, y = release_tokens(a), release_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


# Names and titles that may stay as they are in a translation, and what each label of a bad translation looks for.
QA_NAMES = ("Guts", "Griffith", "Casca", "Judeau", "Pippin", "Rickert", "Corkus", "Charlotte", "Adon", "Coborlwitz", "Ganzansenpu", "Band of the Hawk", "Hawks", "Raiders", "Blue Whale Super Strong Heavy Assault Knights", "lord", "sir")
SMALL, CAPITAL = "a-ząćęłńóśźż", "A-ZĄĆĘŁŃÓŚŹŻ"


def qa_issues(out: Column, names: tuple[str, ...] = QA_NAMES) -> Column:
    """Labels of what looks wrong in a translation: plain-Latin words left over, known bad words, capitals inside a sentence. Null for null."""
    known = F.array(*[F.lit(n.lower()) for n in names])
    # A word: letters, digits and underscores with none beside them. No lambdas and no test that repeats its label, so each is looked for once.
    word = lambda x: rf"(?<![\p{{L}}\p{{N}}_]){x}(?![\p{{L}}\p{{N}}_])"
    left = F.array_except(F.regexp_extract_all(F.lower(out), F.lit(word("[a-z]{4,}")), F.lit(0)), known)
    some = lambda what, found: F.concat(F.lit(f"{what}: "), F.nullif(F.array_join(found, ","), F.lit("")))
    inside = F.regexp_extract_all(out, F.lit(rf"[{SMALL}]\s+[{CAPITAL}][{SMALL}]"), F.lit(0))
    labels = [
        some("untranslated", F.sort_array(left)),
        F.when(F.lower(out).rlike("wnętrzności|wnetrznosci"), F.lit("GUTS→Wnętrzności")),
        F.when(out.rlike(word("Kaska")), F.lit("Casca→Kaska")),
        F.when(out.rlike(word("Marzec")), F.lit("March→Marzec")),
        F.when(stripped(out).rlike("^Ładuj!?$"), F.lit("Charge→Ładuj")),
        some("mid-sentence caps", F.slice(inside, 1, 2)),
        F.when(F.contains(F.lower(out), F.lit("strajk")), F.lit("strike→strajk")),
    ]
    none = F.array().cast("array<string>")
    return F.concat(F.array_except(F.array(*labels), F.array(F.lit(None).cast("string"))), F.when(out.isNotNull(), none))


# Commands answered before translation, and corrections after it (pattern, replacement) in this order.
GLOSSARY = {"march": "Naprzód!", "charge": "Do ataku!"}
CORRECTIONS = [
    (r"(?U)\bMarzec\b", "Naprzód"), (r"(?iU)\bDobra droga\b", "Tak trzymaj"), (r"(?iU)\bWnętrzności\b", "Guts"), (r"(?iU)\bKaska\b", "Casca"),
    (r"(?iU)\bstrajk\b", "cios"), (r"^Ładuj!$", "Do ataku!"), (r"(?iU)Weź to razem", "Weź się w garść"),
]


def glossary_pre(text: Column) -> Column:
    """The glossary's answer for a line that is one of its commands, with any number of exclamation marks; else the line."""
    low = F.regexp_replace(stripped(F.lower(text)), "!+$", "")
    return reduce(lambda w, kv: w.when(low == kv[0], kv[1]), GLOSSARY.items(), F.when(F.lit(False), "")).otherwise(text)


def glossary_post(text: Column) -> Column:
    return _replaced(text, CORRECTIONS)


def phrase_table(spark: SparkSession) -> DataFrame:
    """(base, answer, kind) of both dictionaries; one-word entries win where both have a base."""
    rows = [(k, v, "single") for k, v in WORDS.items()] + [(k, v, "multi") for k, v in PHRASES.items() if k not in WORDS]
    return spark.createDataFrame(rows, "base string, answer string, phrase_kind string")


def phrase_answers(cues: DataFrame) -> DataFrame:
    """Adds answer (the formatted dictionary answer, null where there is none) and phrase_kind.

    The dictionary is a constant table of fewer than a hundred rows, so it is broadcast.
    """
    # Step by step, each from the column before, so that nothing is made twice; only lines with an answer need its form.
    based = cues.withColumn("_s", trimmed(F.col("text"))).withColumn("_b", _base(F.col("_s"))).withColumn("base", F.lower("_b"))
    found = based.join(F.broadcast(phrase_table(cues.sparkSession)), "base", "left")
    answer = apply_formatting(F.col("answer"), _punct(F.col("_s")), _cap(F.col("_b")))
    return found.withColumn("answer", F.when(F.col("answer").isNotNull(), answer)).drop("base", "_s", "_b")


def phrase_lookup(cues: DataFrame) -> DataFrame:
    """Adds translation (the formatted dictionary answer, or the line with idioms rewritten), answered and phrase_kind."""
    answer = F.col("answer")
    return phrase_answers(cues).withColumns({"translation": F.coalesce(answer, rewrite_idioms(F.col("text"))), "answered": answer.isNotNull()}).drop("answer")


def preprocess_stats(cues: DataFrame) -> DataFrame:
    """Counts of dictionary answers, idioms and lines, and the share answered in percent."""
    f = phrase_lookup(cues)
    idiom = ~F.col("answered") & (F.col("translation") != F.col("text"))
    return f.agg(
        F.count_if(F.col("phrase_kind") == "single").alias("single"), F.count_if(F.col("phrase_kind") == "multi").alias("multi"), F.count_if(idiom).alias("idioms"), F.count(F.lit(1)).alias("total")
    ).withColumn("hit_rate", F.when(F.col("total") > 0, (F.col("single") + F.col("multi")) * 100.0 / F.col("total")).otherwise(0.0))
