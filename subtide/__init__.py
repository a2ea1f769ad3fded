"""Timed-text analytics on Spark: DataFrame operators for subtitle and other timed-text tables."""
