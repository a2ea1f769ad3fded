"""A Merkle manifest of a table: aligned subtrees as blocks in van Emde Boas order, a proof for every row, and what a change does to it.

A tree of eight children a node is cut into blocks of BLOCK_HEIGHT levels below a root. Their leaves are rows; the roots of these blocks are
the leaves of the next tier, and so on up to one block. Inside a block nodes lie in van Emde Boas order: the levels
are split at half height, first the upper subtree, then each lower one in turn, all in the same way. So a path
from leaf to root touches few runs of the block whatever the size of a page, and where a node lies is arithmetic.

Rows are numbered by a range partition and prefix sums, never in one task; a block goes through one task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from subtide.session import written

#: Children a node has, as a power of two, and the levels of a block below its root: 512 leaves.
ARITY_BITS = 3
BLOCK_HEIGHT = 3
ARITY = 1 << ARITY_BITS
DIGEST = 32


def size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return ((1 << ARITY_BITS * levels) - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where node ``index`` of the level ``depth`` (the root's is 0) lies in a tree of ``levels`` levels in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(index)
    above = levels // 2
    if depth < above:
        return address(above, depth, index)
    bits = ARITY_BITS * (depth - above)
    below = levels - above
    return size(above) + (index >> bits) * size(below) + address(below, depth - above, index & ((1 << bits) - 1))


@functools.cache
def addresses(height: int) -> list[np.ndarray]:
    """The addresses of each level of a block, from its root down."""
    return [address(height + 1, depth, np.arange(1 << ARITY_BITS * depth)) for depth in range(height + 1)]


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def least_height(n: int) -> int:
    """The height at which one node remains of ``n``."""
    height = 0
    while 1 << ARITY_BITS * height < n:
        height += 1
    return height


def build_block(leaves: list[str], height: int) -> bytes:
    """The nodes of a block over ``leaves`` (hex digests in order), each at its address; where there is no node there are zeros."""
    at = addresses(height)
    nodes = np.zeros((size(height + 1), DIGEST), np.uint8)
    nodes[at[height][: len(leaves)]] = np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, DIGEST)
    n = len(leaves)
    for depth in range(height, 0, -1):
        children = at[depth][:n]
        n = -(-n // ARITY)
        for parent in range(n):
            run = nodes[children[ARITY * parent : ARITY * (parent + 1)]].tobytes().hex()
            nodes[at[depth - 1][parent]] = np.frombuffer(hashlib.sha256(run.encode()).digest(), np.uint8)
    return nodes.tobytes()


def block_root(nodes: bytes) -> str:
    return nodes[:DIGEST].hex()


def steps(nodes: bytes, n: int, height: int) -> Iterator[tuple[str, ...]]:
    """For each of the ``n`` leaves of a block its steps upward: (place in the run, siblings before it and after it as one hex text), flat.

    Each node's step is cut once from the run of its parent; upper ones are shared by the leaves below.
    """
    at = addresses(height)
    table = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    above: list[tuple[tuple[int, str], ...]] = [()]
    for depth in range(1, height + 1):
        count = -(-n // (1 << ARITY_BITS * (height - depth)))
        here = []
        for parent in range(-(-count // ARITY)):
            run = table[at[depth][ARITY * parent : min(count, ARITY * (parent + 1))]].tobytes().hex()
            for i in range(len(run) // (2 * DIGEST)):
                here.append(((i, run[: 2 * DIGEST * i] + run[2 * DIGEST * (i + 1) :]), *above[parent]))
        above = here
    return iter(above)


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that ``leaf`` and the siblings on its way give."""
    for place, siblings in path:
        cut = 2 * DIGEST * place
        leaf = _hash(siblings[:cut], leaf, siblings[cut:])
    return leaf


# -- in Spark -----------------------------------------------------------------------------------------


def field_text(column: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(columns: list[Column]) -> Column:
    """The leaf of a row with these columns in order."""
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with _pos (from 0 in its group by ``order``, nulls first) and _of (rows of the group), as tables in the shared folder.

    Range partitions by group and order hold runs of groups, so a row's place is its place in the run plus the sizes of
    the group's runs in earlier ranges: a hot group and repeated rows spread over ranges. Needs narrow rows.
    """
    by = [F.col(c).asc_nulls_first() for c in [group, *order, "_tie"]]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    kept = written(ranged.drop("_tie").withColumn("_seq", F.monotonically_increasing_id()), label).withColumn("_range", F.shiftright("_seq", 33))
    runs = kept.groupBy(group, "_range").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group in it
    offsets = runs.select(group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_of"))
    placed = kept.join(written(offsets, f"{label}-runs"), [group, "_range"])
    return placed.withColumn("_pos", F.col("_before") + F.col("_seq") - F.col("_first")).drop("_seq", "_range", "_first", "_before")


@dataclass
class Forest:
    """The trees of a numbered table, one for each group: tiers of blocks from the leaves up, and the roots."""

    tiers: list[DataFrame]  # g, block, n, height, alone, nodes
    roots: DataFrame  # g, root
    bits: int  # of a place within a block


def grow(leaves: DataFrame, label: str, block_height: int) -> Forest:
    """The trees over ``leaves``: g, _pos, _of, digest (hex). Each tier is written once.

    A block that is its group's tier by itself ends where one node remains; others have the full height, however few their leaves.
    """
    bits = ARITY_BITS * block_height

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        alone = rows.column("_of")[0].as_py() <= 1 << bits
        height = least_height(rows.num_rows) if alone else block_height
        nodes = build_block(rows.column("digest").to_pylist(), height)
        made = {"g": [key[0].as_py()], "block": [key[1].as_py()], "n": [rows.num_rows], "height": [height], "alone": [alone], "nodes": [nodes]}
        kinds = [("g", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32()), ("alone", pa.bool_()), ("nodes", pa.binary())]
        return pa.table(made, schema=pa.schema(kinds))

    tiers, roots = [], None
    while True:
        keyed = leaves.select("g", F.shiftright("_pos", bits).alias("block"), "_pos", "_of", "digest")
        tier = written(keyed.groupBy("g", "block").applyInArrow(block, "g string, block bigint, n int, height int, alone boolean, nodes binary"), f"{label}-tier{len(tiers)}")
        tiers.append(tier)
        top = F.lower(F.hex(F.substring("nodes", 1, DIGEST)))
        done = tier.where("alone").select("g", top.alias("root"))
        roots = done if roots is None else roots.union(done)
        more = tier.where("NOT alone")
        if more.isEmpty():
            return Forest(tiers, roots, bits)
        sizes = more.groupBy("g").agg(F.count(F.lit(1)).alias("_of"))
        leaves = more.select("g", F.col("block").alias("_pos"), top.alias("digest")).join(sizes, "g")


#: A path in a table: for each level the place of the node in its run, and its siblings.
PATH = "array<struct<place:int,siblings:string>>"
_PATH = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


def climb(forest: Forest, ends: DataFrame) -> DataFrame:
    """g, block, n, height, alone, nodes, path: the lowest tier's blocks with the way from their roots to the root of all. ``ends``: g, path above the group's root."""

    bits = forest.bits

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                above = [tuple(s.values()) for s in row["path"]]
                paths = [[*path, *above] for path in steps(row["nodes"], row["n"], row["height"])]
                first = row["block"] << bits
                made = [[row["g"]] * len(paths), range(first, first + len(paths)), [[{"place": p, "siblings": s} for p, s in path] for path in paths]]
                yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.int64()), pa.array(made[2], _PATH)], names=["g", "block", "path"])

    below = None
    for tier in reversed(forest.tiers):
        # A tree's topmost block takes the way above its root; a lower one that of its place in the block above.
        paths = tier.where("alone").join(ends, "g")
        if below is not None:
            paths = paths.unionByName(tier.where("NOT alone").join(below, ["g", "block"]))
        if tier is forest.tiers[0]:
            return paths
        below = paths.mapInArrow(split, f"g string, block bigint, path {PATH}")
    raise ValueError("a forest has a tier")


@dataclass
class Manifest:
    """Leaves as numbered (with whatever columns they bring), the groups' trees, their roots as numbered leaves, and the tree over these."""

    leaves: DataFrame
    groups: Forest
    tops: DataFrame
    whole: Forest


def build(leaves: DataFrame, order: list[str], block_height: int = BLOCK_HEIGHT) -> Manifest:
    """The manifest of ``leaves``: g (the group, sorted as bytes, not null), digest (hex), the columns of ``order``, and others to keep.

    Null in ``order`` sorts first; ties are ordered by digest. An empty table has no roots.
    """
    placed = numbered(leaves, "g", [*order, "digest"], "leaves")
    groups = grow(placed, "groups", block_height)
    tops = numbered(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("digest")), "g", ["of"], "tops")
    return Manifest(placed, groups, tops, grow(tops, "whole", block_height))


def _walk(forest: Forest, leaves: DataFrame, ends: DataFrame, keep: list[str], made: dict[str, tuple[str, pa.DataType]], of: Callable) -> DataFrame:
    """g, the ``keep`` columns, leaf, and ``of(row, leaf, path)`` as the columns ``made``: each lowest block meets its leaves once."""
    rows = leaves.select("g", "_pos", F.shiftright("_pos", forest.bits).alias("block"), F.col("digest").alias("leaf"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in ["g", *keep, "leaf"]], *[f"`{c}` {kind}" for c, (kind, _) in made.items()]])

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_pos")
        block = right.to_pylist()[0]
        above = [tuple(s.values()) for s in block["path"]]
        paths = steps(block["nodes"], block["n"], block["height"])
        found = [of(row, leaf, [*path, *above]) for row, leaf, path in zip(left.select(keep).to_pylist(), left.column("leaf").to_pylist(), paths)]
        arrays = [pa.array(values, kind) for values, (_, kind) in zip(zip(*found), made.values())]
        return pa.table([*[left.column(c) for c in ["g", *keep, "leaf"]], *arrays], names=["g", *keep, "leaf", *made])

    return rows.groupBy("g", "block").cogroup(climb(forest, ends).groupBy("g", "block")).applyInArrow(walk, schema)


def _whole_path(row: dict, leaf: str, path: list[tuple[int, str]]) -> tuple:
    return ([{"place": p, "siblings": s} for p, s in path],)


def top_paths(manifest: Manifest) -> DataFrame:
    """g, subroot, root, path: the way from each group's root to the root of all, as a table in the shared folder."""
    ends = manifest.whole.roots.select("g", F.array().cast(PATH).alias("path"))
    found = _walk(manifest.whole, manifest.tops, ends, ["of"], {"path": (PATH, _PATH)}, _whole_path).join(manifest.whole.roots, "g")
    return written(found.select(F.col("of").alias("g"), F.col("leaf").alias("subroot"), "root", "path"), "top-paths")


def proofs(manifest: Manifest, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, leaf, subroot, root and path (the siblings from the leaf to the root of all) of each row."""
    return proven(manifest, keep, {"path": (PATH, _PATH)}, _whole_path)


def proven(manifest: Manifest, keep: list[str], made: dict[str, tuple[str, pa.DataType]], of: Callable) -> DataFrame:
    """The same, with ``of(row, leaf, path)`` as the columns ``made`` (name to Spark and Arrow type) in place of the path."""
    tops = top_paths(manifest)
    found = _walk(manifest.groups, manifest.leaves, tops.select("g", "path"), keep, made, of)
    return found.join(tops.select("g", "subroot", "root"), "g").select(*keep, "leaf", "subroot", "root", *made)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, g, digest and tampered of each row.

    g is the language (null apart from and before '', as bytes). ``tampered`` is the digest that the row would have with the A-Z of its text
    in lower case, where 3 divides the CRC-32 of the decimal doc_id; else, and where doc_id is null, null.
    """
    fields = lambda text: row_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"), fields(F.col("text")).alias("digest"), F.when(chosen, fields(low)).alias("tampered"))


def audit(docs: DataFrame, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Documents are leaves, in a tree for each language by doc_id (null first; rows of one doc_id by their digest), and the languages'
    roots, null first, then as bytes, are leaves of one more. ``proof_sha256`` is the hash of all siblings on the way
    up; ``folded_root`` what the tampered (else the true) leaf gives with them, ``verified`` whether that is the root. Repeated rows are
    leaves each. Text null or empty is hashed as such. An empty table gives no rows. Of ``docs`` only doc_id, source, lang, n_chars and text are read.
    """
    manifest = build(written(document_leaves(docs), "document-leaves"), ["doc_id"], block_height)
    made = {"proof_sha256": ("string", pa.string()), "folded_root": ("string", pa.string())}
    found = proven(manifest, ["doc_id", "tampered"], made, lambda row, leaf, path: (_hash(*[s for _, s in path]), fold(row["tampered"] or leaf, path)))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
