"""N-gram Jaccard join by a token-group matrix.

1. Every text becomes a set of shingle hashes. All sets meet once in an inverted index, shipped as packed
   numbers, that counts for each document how many of its shingles any other document has. A document that
   lacks the share the threshold asks for has no partner and is done.
2. The others' sets are kept; equal sets are one from here on.
3. Similar sets are put into groups of bounded size. A group keeps its members' sets, the union of their
   tokens and the links inside it.
4. The token-group matrix holds, for every group, the tokens that a partner of a member must share one of
   (the rarest tokens of each set). Two groups that share one, and whose sizes allow a link, are compared by
   the overlap of their unions; only groups that qualify are opened and their members compared. First each
   token's groups are opened as a chain, which connects families of copies; then only groups with members
   that share a token and aren't connected yet.
5. Links connect components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.llm.components import connected_components
from subtide.llm.shingles import mix, shingle_sets
from subtide.session import batch_bytes, held, written

#: Shingles that a task indexes at a time.
CHUNK_TOKENS = 1 << 19
CHUNK_DOCS = (1 << 16) - 1
#: Text whose shingles lie in one bucket of the index, on average.
BUCKET_BYTES = 32 << 20
#: A token in at least so many sets comes after all rarer ones in the order that picks the tokens to share.
#: If more than HOT_TOKENS tokens are that frequent, the bar is doubled; the result does not depend on it.
HOT_SETS = 16
HOT_TOKENS = 500_000
#: Bounds of a group, and how many are open at a time while groups are made.
GROUP_DOCS = 256
GROUP_TOKENS = 1 << 17
OPEN_GROUPS = 32
#: Sets of one key that are grouped together; a key with more is dealt out in pieces.
PIECE_SETS = 256
#: Sets this similar to a group's first one join it.
GROUP_SIMILARITY = 0.25
#: Tables of document ids are broadcast up to so many rows, else shuffled.
BROADCAST_IDS = 500_000
#: Arrow batches of texts and sets.
BATCH_BYTES = 8 << 20


def needed(n, percent: int):
    """The shingles that a set of ``n`` must share with any partner."""
    return -(-percent * n // 100)


# -- 1. documents without partners -----------------------------------------------------------------


def _pack(ids: list, sets: list[np.ndarray], chunk: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """A chunk's rows for the index: its tokens by bucket, and one row of what is known already.

    A token that several documents of the chunk have is known to be shared; it is shipped once, for the
    other chunks' sake, with no owner. A bucket's tokens are those of a range, so sorted tokens fall into
    buckets one after another.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(m, dtype=np.int64), sizes)
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    group = np.cumsum(first) - 1
    several = np.bincount(group)[group] > 1 if len(tokens) else np.empty(0, bool)
    here = np.bincount(owner[several], minlength=m)
    null = np.array([i is None for i in ids], np.int64)
    known = np.concatenate([np.array([0 if i is None else i for i in ids], np.int64), null, sizes, here.astype(np.int64)])
    yield -1 - chunk, chunk, known.tobytes()
    owner = np.where(several, m, owner)[first]
    tokens = tokens[first]
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    if len(tokens):
        low, owner = tokens.astype("<u4"), owner.astype("<u2")
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(tokens)]):
            yield int(bucket[a]), chunk, low[a:b].tobytes() + owner[a:b].tobytes()


def _index_rows(k: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        sets: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            packed = list(_pack(ids, sets, base + seq, buckets))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int64()), pa.array([p[1] for p in packed], pa.int64()), pa.array([p[2] for p in packed], pa.binary())], names=["bucket", "chunk", "payload"])

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k)):
                ids.append(doc)
                sets.append(own)
                size += len(own)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield flush()
                    ids, sets, size, seq = [], [], 0, seq + 1
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return rows


_INDEX = "bucket bigint, chunk bigint, payload binary"


def _count_shared(rows: pa.Table) -> pa.Table:
    """For each chunk of a bucket: the owners of the tokens that another chunk has too."""
    if rows["bucket"][0].as_py() < 0:
        return rows
    payloads = [x.as_buffer() for x in rows["payload"]]
    sizes = [x.size // 6 for x in payloads]
    tokens = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(payloads, sizes)])
    order = np.argsort(tokens)
    ranked = tokens[order]
    same = np.zeros(len(tokens), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:].copy()
    shared = np.empty(len(tokens), bool)
    shared[order] = same
    out, at = [], 0
    for payload, n in zip(payloads, sizes):
        out.append(np.frombuffer(payload, "<u2", n, 4 * n)[shared[at : at + n]].tobytes())
        at += n
    return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "payload": pa.array(out, pa.binary())})


def _sum_shared(rows: pa.Table) -> pa.Table:
    """A chunk's documents: id, size of the set, and how many of its tokens any other document has."""
    known, counted = None, []
    for bucket, payload in zip(rows["bucket"].to_pylist(), rows["payload"]):
        if bucket < 0:
            known = np.frombuffer(payload.as_buffer(), np.int64).reshape(4, -1)
        else:
            counted.append(np.frombuffer(payload.as_buffer(), "<u2"))
    total = known[3].copy()
    for owners in counted:
        total += np.bincount(owners, minlength=len(total) + 1)[: len(total)]
    return pa.table({"doc_id": pa.array(known[0], pa.int64(), mask=known[1] == 1), "n_shingles": pa.array(known[2]), "n_shared": pa.array(total)})


def shared_shingles(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles and n_shared (shingles that another row has too, or a few more) of every row of ``docs``.

    Tokens are cut to the bucket's number and 32 more bits, so n_shared may be a little high, never low.
    The number of buckets follows the texts' size, so that one bucket fits a task whatever the table's size.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    index = docs.select("doc_id", "text").mapInArrow(_index_rows(k, buckets), _INDEX)
    counted = index.groupBy("bucket").applyInArrow(_count_shared, _INDEX)
    return counted.groupBy("chunk").applyInArrow(_sum_shared, "doc_id bigint, n_shingles bigint, n_shared bigint")


# -- 2. the sets of the rest -----------------------------------------------------------------------


def _set_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sets = [], [], []
            for doc, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k)):
                if len(own):
                    ids.append(doc)
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sets.append(own.view(np.int64))
            if ids:
                ends = np.cumsum([0] + [len(s) for s in sets])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), tokens], names=["doc_id", "set_key", "tokens"])

    return rows


def only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose doc_id is (``left_semi``) or isn't (``left_anti``) among ``ids``, broadcast if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)


# -- 3. groups -------------------------------------------------------------------------------------


def _hot_tokens(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens (sorted) and in how many sets they are; at most HOT_TOKENS."""
    counts = held(sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_SETS))
    bar = HOT_SETS
    while counts.where(F.col("n") >= bar).count() > HOT_TOKENS:
        bar *= 2
    got = counts.where(F.col("n") >= bar).toArrow()
    tokens, n = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _frequency(own: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many sets each token is if it is a frequent one, else 0."""
    tokens, n = hot
    if not len(tokens):
        return np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
    return np.where(tokens[at] == own, n[at], 0)


def _keyed(hot):
    """Adds the key by which similar sets lie near each other: the least mixed hash among a set's frequent tokens, or all."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at, values = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
            keys = []
            for a, b in zip(at[:-1], at[1:]):
                own = values[a:b]
                often = own[_frequency(own, hot.value) > 0]
                keys.append(int(mix(often if len(often) else own).min() >> np.uint64(1)))
            sizes = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), sizes, batch.column(0), column], names=["near", "n", "doc_id", "tokens"])

    return rows


def overlaps(a: list[np.ndarray], b: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of ``a`` with each of ``b``, over the tokens in ``union`` (sorted)."""
    out = np.zeros((len(a), len(b)))
    for low in range(0, len(union), 8192):
        part = union[low : low + 8192]
        sides = []
        for sets in (a, b):
            x = np.zeros((len(sets), len(part)), np.float32)
            for i, own in enumerate(sets):
                lo, hi = np.searchsorted(own, part[[0, -1]])
                own = own[lo : hi + 1]
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                x[i, at[part[at] == own]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


class _Forest:
    """Which of a few sets are connected already."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


class _Group:
    def __init__(self, doc: int, own: np.ndarray):
        self.docs, self.sets, self.size = [doc], [own], len(own)

    def takes(self, own: np.ndarray) -> bool:
        if len(self.docs) >= GROUP_DOCS or self.size + len(own) > GROUP_TOKENS:
            return False
        first = self.sets[0]
        if min(len(first), len(own)) < GROUP_SIMILARITY * max(len(first), len(own)):
            return False
        at = np.minimum(np.searchsorted(first, own), len(first) - 1)
        both = int((first[at] == own).sum())
        return both >= GROUP_SIMILARITY * (len(first) + len(own) - both)


def _linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], union: np.ndarray, percent: int) -> list[list[int]]:
    """Positions (i, j) of linked sets."""
    both = overlaps(sets_a, sets_b, union)
    sizes_a, sizes_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    return np.argwhere(100 * both >= percent * (sizes_a[:, None] + sizes_b[None, :] - both)).tolist()


def _heads(docs: list[int], sets: list[np.ndarray], union: np.ndarray, percent: int) -> list[int]:
    """For each document of a group the smallest one that it is connected with inside the group."""
    forest = _Forest(len(docs))
    if len(docs) > 1:
        for i, j in _linked(sets, sets, union, percent):
            forest.join(i, j)
    least: dict[int, int] = {}
    for i, doc in enumerate(docs):
        top = forest.top(i)
        least[top] = min(least.get(top, doc), doc)
    return [least[forest.top(i)] for i in range(len(docs))]


def _lists(arrays: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    """``values`` as lists as long as ``arrays``."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)


def _group_rows(hot, percent: int):
    def matrix(group: _Group) -> np.ndarray:
        """The tokens of which a partner of a member must have one."""
        rare = []
        for own in group.sets:
            order = np.lexsort((own, _frequency(own, hot.value)))
            rare.append(own[order[: len(own) - needed(len(own), percent) + 1]])
        return np.unique(np.concatenate(rare)).view(np.int64)

    def table(groups: list[_Group], first: int) -> pa.RecordBatch:
        heads = [_heads(g.docs, g.sets, np.unique(np.concatenate(g.sets)), percent) for g in groups]
        tokens = [matrix(g) for g in groups]
        sizes = [np.array([len(s) for s in g.sets], np.int32) for g in groups]
        ids = lambda lists: _lists(lists, pa.array(np.concatenate(lists).astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(first, first + len(groups)), pa.int64()), ids([g.docs for g in groups]), _lists(sizes, pa.array(np.concatenate(sizes))),
                pa.array([np.concatenate(g.sets).tobytes() for g in groups], pa.binary()), pa.array([int(s.min()) for s in sizes], pa.int64()), pa.array([int(s.max()) for s in sizes], pa.int64()),
                ids(tokens), ids(heads),
            ],
            names=["gid", "docs", "sizes", "tokens", "least", "most", "matrix", "heads"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 32
        near, open_groups, made, size = None, [], [], 0
        for batch in batches:
            column = batch.column(3)
            at, values = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
            for i, (key, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = values[at[i] : at[i + 1]].copy()
                closed = []
                if key != near:
                    closed, open_groups, near = open_groups, [], key
                for group in reversed(open_groups):
                    if group.takes(own):
                        group.docs.append(doc)
                        group.sets.append(own)
                        group.size += len(own)
                        break
                else:
                    open_groups.append(_Group(doc, own))
                    if len(open_groups) > OPEN_GROUPS:
                        closed.append(open_groups.pop(0))
                for group in closed:
                    made.append(group)
                    size += group.size
                    if size > 1 << 19 or len(made) >= 1000:
                        yield table(made, gid)
                        gid, made, size = gid + len(made), [], 0
        made += open_groups
        if made:
            yield table(made, gid)

    return rows


GROUPS = "gid bigint, docs array<bigint>, sizes array<int>, tokens binary, least bigint, most bigint, matrix array<bigint>, heads array<bigint>"


# -- 4. opening groups -----------------------------------------------------------------------------


def _fits(percent: int) -> Column:
    """The sizes of two groups' sets allow a link."""
    return (100 * F.col("h_most") >= percent * F.col("g_least")) & (100 * F.col("g_most") >= percent * F.col("h_least"))


def chained_groups(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h) of groups that follow one another among those of a matrix token; their number grows with the matrix alone."""
    follows = Window.partitionBy("token").orderBy("gid")
    nexts = [F.lead(a).over(follows).alias(b) for a, b in (("gid", "h"), ("least", "h_least"), ("most", "h_most"))]
    chain = cells.select(F.col("gid").alias("g"), F.col("least").alias("g_least"), F.col("most").alias("g_most"), *nexts)
    return chain.where(F.col("h").isNotNull() & _fits(percent)).select("g", "h").distinct()


def candidate_groups(cells: DataFrame, members: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h), g < h, of groups that share a token of the matrix and aren't all of one component, if the sizes allow a link.

    ``members``: (gid, head). A group whose heads are all of one component stands for it; any other for
    itself alone. What groups stand for meets on the tokens first, then the groups, so those of one component don't meet.
    """
    placed = members.join(components.withColumnRenamed("node", "head"), "head", "left").withColumn("c", F.coalesce("component", "head"))
    whole = placed.groupBy("gid").agg(F.min("c").alias("c"), F.max("c").alias("_m"))
    stands = whole.select("gid", F.when(F.col("c") == F.col("_m"), F.concat(F.lit("c"), "c")).otherwise(F.concat(F.lit("g"), "gid")).alias("c"))
    few = stands.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = cells.join(F.broadcast(stands) if few else stands, "gid")
    several = named.groupBy("token").agg((F.min("c") != F.max("c")).alias("several")).where("several").select("token")
    named = held(named.join(several, "token", "left_semi"))
    of = named.select("token", "c").distinct()
    met = of.join(of.withColumnRenamed("c", "d"), "token").where("c < d")
    sides = [named.select("token", F.col("gid").alias(s), F.col("least").alias(f"{s}_least"), F.col("most").alias(f"{s}_most"), F.col("c").alias(c)) for s, c in (("g", "c"), ("h", "d"))]
    pairs = met.join(sides[0], ["token", "c"]).join(sides[1], ["token", "d"]).where(_fits(percent))
    return pairs.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()


def _open(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            sides = [[batch.column(batch.schema.get_field_index(f"{side}_{c}")) for c in ("heads", "sizes", "tokens")] for side in "gh"]
            for i in range(batch.num_rows):
                (heads_a, sets_a, union_a), (heads_b, sets_b, union_b) = [(d[i].as_py(), *_unpack(s[i].as_py(), t[i].as_py())) for d, s, t in sides]
                union = np.intersect1d(union_a, union_b, assume_unique=True)
                least = max(min(map(len, sets_a)), min(map(len, sets_b)))
                if len(union) < needed(least, percent):
                    continue  # no member of one can share enough with a member of the other
                # What is connected inside a group needs one link to the other at most.
                found += sorted({(heads_a[i], heads_b[j]) for i, j in _linked(sets_a, sets_b, union, percent)})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows


def _unpack(sizes: list[int], tokens: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    flat = np.frombuffer(tokens, np.uint64)
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    return sets, flat if len(sets) == 1 else np.unique(flat)


def similarity_groups(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, head) of every distinct set (doc_id, tokens), and links (a, b) between heads.

    Two sets are connected by links of a Jaccard similarity of ``percent`` or more if and only if their
    heads are equal or connected.
    """
    spark = sets.sparkSession
    hot = spark.sparkContext.broadcast(_hot_tokens(sets))
    keyed = sets.select("doc_id", "tokens").mapInArrow(_keyed(hot), "near bigint, n bigint, doc_id bigint, tokens array<bigint>")
    sizes = held(keyed.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / PIECE_SETS).alias("pieces")).where("pieces > 1"))
    few = sizes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    piece = F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1).cast("long")))
    dealt = keyed.join(F.broadcast(sizes) if few else sizes, "near", "left").select(F.xxhash64("near", piece).alias("near"), "n", "doc_id", "tokens")
    groups = written(dealt.repartition("near").sortWithinPartitions("near", "n", "doc_id").mapInArrow(_group_rows(hot, percent), GROUPS), "groups")
    cells = groups.select("gid", "least", "most", F.explode("matrix").alias("token"))
    members = groups.select("gid", F.explode(F.array_distinct("heads")).alias("head"))
    sides = [groups.select(F.col("gid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("heads", "sizes", "tokens")]) for s in "gh"]
    opened = lambda pairs: pairs.join(sides[0], "g").join(sides[1], "h").mapInArrow(_open(percent), "a bigint, b bigint")
    chained = held(opened(chained_groups(cells, percent)).distinct())
    links = chained.union(opened(candidate_groups(cells, members, connected_components(chained), percent)))
    heads = groups.select(F.explode(F.arrays_zip("docs", "heads")).alias("x")).select(F.col("x.docs").alias("doc_id"), F.col("x.heads").alias("head"))
    return heads, links


# -- 5. components ---------------------------------------------------------------------------------


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row of ``docs``.

    Two documents link if their sets of ``k``-word shingles have a Jaccard similarity of ``percent`` or
    more. No link between different texts is lost, whatever groups and frequencies come out; shingles are
    compared by 64-bit hashes.

    A null or empty text, or one without words, has an empty set and links with nothing. A text of fewer
    than ``k`` words is one shingle. Rows that share a doc_id are one document with several texts: a link
    of any of them links it. Rows with a null doc_id have a size but no component and no links. An
    empty table gives an empty table. Other columns are not read.
    """
    with batch_bytes(docs.sparkSession, BATCH_BYTES):  # every step in Python is part of an action in here
        return _similar_documents(docs, k, percent)


def _similar_documents(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sizes = held(shared_shingles(docs, k))
    partners = sizes.where((F.col("n_shingles") > 0) & (100 * F.col("n_shared") >= percent * F.col("n_shingles"))).select("doc_id").where("doc_id IS NOT NULL").distinct()
    kept = only(docs.select("doc_id", "text"), partners).mapInArrow(_set_rows(k), "doc_id bigint, set_key binary, tokens array<bigint>")
    sets = written(kept.withColumn("row", F.monotonically_increasing_id()), "sets")
    first = held(sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")))
    few = first.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = first.select("row")
    heads, links = similarity_groups(sets.join(F.broadcast(rows) if few else rows, "row", "left_semi"), percent)
    # Each document's first head; the heads of one document's several texts belong together.
    of_set = first.select("set_key", "rep").join(heads.withColumnRenamed("doc_id", "rep"), "rep").select("set_key", "head")
    of_doc = held(sets.select("doc_id", "set_key").join(of_set, "set_key").groupBy("doc_id").agg(F.min("head").alias("head"), F.collect_set("head").alias("heads")))
    several = of_doc.where(F.size("heads") > 1).select(F.explode("heads").alias("a"), F.col("head").alias("b"))
    components = connected_components(links.union(several))
    placed = of_doc.select("doc_id", "head").join(components.withColumnRenamed("node", "head"), "head", "left").select("doc_id", F.coalesce("component", "head").alias("component"))
    return sizes.join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each_group(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the rows that are linked, directly or not, with a document of smaller doc_id; columns as they were."""
    found = similar_documents(docs, k, percent)
    return only(docs, held(found.where("component_id != doc_id").select("doc_id").distinct()), "left_anti").select(*docs.columns)
