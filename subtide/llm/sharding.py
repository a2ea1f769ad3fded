"""Contiguous, byte-balanced shards from global prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from subtide.session import held


def byte_shards(rows: DataFrame, size: str, order: list[str], n_shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to ``rows``: contiguous runs of the order, nearly equal in bytes.

    Rows are dealt to ranges of ``order``; each range's total goes into a prefix sum over ranges
    (as many rows as partitions), and a running sum inside the range gives every row the bytes
    before it. The row whose middle byte lies in the k-th of ``n_shards`` equal parts of the total
    goes to shard k, so a shard is off its target by less than one row's size. ``slot`` counts from
    0 within the shard without a gap.

    ``rows`` should be narrow (keys and sizes): it is checkpointed once, because a range partition
    made twice may be cut elsewhere.

    Nulls in ``order`` sort first; a null size counts as 0. Ties and repeated rows keep distinct
    slots, in the order of reading. An empty table gives an empty table; if all sizes are 0 every
    row goes to shard 0. Columns of ``rows`` keep their names; the working columns begin with
    ``_cut_`` and ``shard`` and ``slot`` replace columns of that name.
    """
    rows = rows.drop("shard", "slot").withColumn("_cut_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*order, "_cut_tie"]]
    ranges = held(
        rows.withColumn("_cut_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
        .repartitionByRange(*by)
        .withColumn("_cut_range", F.spark_partition_id())
    )
    totals = ranges.groupBy("_cut_range").agg(F.sum("_cut_size").alias("_cut_bytes"), F.count(F.lit(1)).alias("_cut_rows"))
    # One row per partition, so a window over all of them stays small, and so does its broadcast.
    before = Window.orderBy("_cut_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_cut_range",
        F.coalesce(F.sum("_cut_bytes").over(before), F.lit(0)).alias("_cut_bytes_before"),
        F.coalesce(F.sum("_cut_rows").over(before), F.lit(0)).alias("_cut_rows_before"),
        F.sum("_cut_bytes").over(whole).alias("_cut_total"),
    )
    inside = Window.partitionBy("_cut_range").orderBy(*by)
    running = F.sum("_cut_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        ranges.withColumns({"_cut_end": running, "_cut_rank": F.row_number().over(inside).cast("long")})
        .join(F.broadcast(offsets), "_cut_range")
        .withColumn("_cut_rank", F.col("_cut_rank") - 1 + F.col("_cut_rows_before"))
        # twice the position of the row's middle byte, out of twice the total
        .withColumn("_cut_middle", 2 * (F.col("_cut_bytes_before") + F.col("_cut_end")) - F.col("_cut_size"))
        .withColumn("shard", F.expr(f"CAST(CASE WHEN _cut_total = 0 THEN 0 ELSE least({n_shards - 1}, _cut_middle * {n_shards} DIV (2 * _cut_total)) END AS INT)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_cut_rank").alias("_cut_first"))  # n_shards rows
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_cut_rank") - F.col("_cut_first"))
    return out.select(*[c for c in rows.columns if c != "_cut_tie"], "shard", "slot")


def text_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; a null text has 0 bytes) and text_crc32 (0 for a null text)."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The sharding of a documents table under the law ``bytes``, ascending in doc_id.

    Returns doc_id, size, text_crc32, law, shard, slot and grown_shard (null: under this law a
    further shard moves every cut). Equal texts are separate rows; they lie wherever their doc_id does.
    """
    return byte_shards(text_sizes(docs), "size", ["doc_id"], n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
