"""The registered queries of the timed-text operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subtide.operators import match
from subtide.plans import cue_queries, edge_queries, fetch_queries, frame_queries, match_queries, run_queries, select_queries, text_queries, training_queries
from subtide.sources import adapters

MODULES = [cue_queries, match_queries, text_queries, run_queries, frame_queries, select_queries, edge_queries, fetch_queries, training_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate is right for each video, and how far off it is."""
    return match.best_candidates(adapters.references(spark, sf_dir), adapters.candidate_cues(spark, sf_dir))
