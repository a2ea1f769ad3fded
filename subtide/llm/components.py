"""Connected components by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from subtide.session import held


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a bigint, b bigint); component is the smallest node reachable.

    Each round hangs every larger neighbour, then every smaller one, on the smallest neighbour, until
    nothing moves; the number of rounds grows with the logarithm of the longest chain. Each round is
    checkpointed in the shared folder. Rows with a null end are left out; loops and repeats are harmless.
    """
    now = held(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if print_of == last or print_of["n"] == 0:
            break
        last = print_of
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = held(small.select("e.u", "e.v").where("u != v").distinct())
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
