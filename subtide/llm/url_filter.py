"""URL filtering: a blocked Bloom filter passes possible hits to an exact hash join (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A listed table of at most so many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: The Bloom filter has a 64-bit word for so many entries (four bits each), and at most so many words (8 MB).
KEYS_A_BLOCK = 4
MAX_BLOCKS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table (block int, bits long): one 64-bit block per key, four bits of it set.

    At most ``n_blocks`` rows whatever the number of keys, so it can always be broadcast.
    """
    return (
        keys.select(_block(F.col(key), n_blocks).alias("block"), _mask(F.col(key)).alias("mask"))
        .groupBy("block")
        .agg(F.bit_or("mask").alias("bits"))
    )


def bloom_words(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as one row with an array of ``n_blocks`` words, 0 where there is no block."""
    every = blocks.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("block")).join(blocks, "block", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return listed.select(F.col("all.bits").alias("bits"))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _mask(key: Column) -> Column:
    seed = F.xxhash64(key, F.lit("bits"))
    bits = []
    for k in range(4):
        bits.append(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(seed, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def judge_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", n_blocks: int | None = None, default: str = "allow") -> DataFrame:
    """Judges each row of ``pages`` by the entries of ``listed`` that fit its url.

    ``listed`` has host, path, verdict and ranked (boolean): an entry fits its host and all
    subdomains where the url's path starts with the entry's. Ranked entries are rules: the longest
    wins and is named in ``rule``. The others form a plain list, whose verdict counts where no rule
    fits. A url that nothing fits gets ``default``.

    Every (host suffix, path prefix of a listed length) of a url is a canonical form to look up. It is
    tested, in the row, against a blocked Bloom filter of the listed forms: ``n_blocks`` 64-bit words that go out with
    the scan, by default as many as give KEYS_A_BLOCK entries each, up to MAX_BLOCKS. A row that none of its forms passes
    is judged there and never shuffled. Forms that pass meet the list in an exact hash join that removes the false
    positives, and only their rows are put together again. The list is broadcast up to BROADCAST_ROWS rows and shuffled beyond.

    Returns one row per row of ``pages``: the key, host, path, rule, verdict. A null url or one
    without ``://`` has an empty host and path, no rule and the default verdict. Repeated rows stay
    repeated. Entries that repeat count once; where equal entries disagree, the verdict that sorts
    last wins. Rows of ``listed`` with a null host or path fit nothing. Other columns of ``pages``
    are not looked at, so their names can't clash. Empty tables on either side are fine.
    """
    entries = (
        listed.where("host IS NOT NULL AND path IS NOT NULL")
        .select(
            F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("form"),
            F.length("path").alias("path_length"),
            F.struct(
                F.col("ranked").alias("ranked"),
                (F.length("host") + F.length("path")).alias("length"),
                F.length("host").alias("host_length"),
                F.col("verdict").alias("verdict"),
                F.when(F.col("ranked"), F.concat("host", "path")).alias("rule"),
            ).alias("entry"),
        )
        .groupBy("form", "path_length")
        .agg(F.max("entry").alias("entry"))
    )
    # Distinct path lengths: no more than the longest url has characters.
    lengths = sorted(r[0] for r in entries.select("path_length").distinct().collect())
    n_entries = entries.count()
    n_blocks = n_blocks or min(MAX_BLOCKS, 1 << max(6, (n_entries // KEYS_A_BLOCK).bit_length()))
    urls = pages.select(F.col(key).alias(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    forms = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    bits = bloom_words(blocked_bloom(entries, "form", n_blocks), n_blocks).scalar()
    passing = lambda f: F.element_at("_bits", _block(f, n_blocks) + 1).bitwiseAND(_mask(f)) == _mask(f)
    tried = urls.withColumn("_bits", bits).withColumn("forms", F.filter(forms, passing)).drop("_bits")
    shown = lambda rule, verdict: [key, "host", "path", rule.alias("rule"), verdict.alias("verdict")]
    clear = tried.where(F.coalesce(F.size("forms"), F.lit(0)) <= 0).select(*shown(F.lit(None).cast("string"), F.lit(default)))
    lookup = entries.select("form", "entry")
    maybe = tried.where(F.size("forms") > 0).withColumn("form", F.explode("forms")).drop("forms")
    hits = maybe.join(F.broadcast(lookup) if n_entries <= BROADCAST_ROWS else lookup, "form", "left")
    best = hits.groupBy("_row").agg(F.first(key).alias(key), F.first("host").alias("host"), F.first("path").alias("path"), F.max("entry").alias("entry"))
    return clear.unionByName(best.select(*shown(F.col("entry.rule"), F.coalesce("entry.verdict", F.lit(default)))))
