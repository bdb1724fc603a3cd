"""Scheduled monitors as a table: which are due, how many runs they missed, when they are due again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_due(monitors: DataFrame, now_ms: int) -> DataFrame:
    """id, due, missed, next_due of monitors (id, interval, next_due, enabled) at a time.

    A due monitor runs once, however many runs it missed, and is due again at the first step of its interval after now.
    """
    due = F.col("enabled") & (F.col("next_due") <= now_ms)
    steps = F.floor((F.lit(now_ms) - F.col("next_due")) / F.col("interval"))
    return monitors.select("id", due.alias("due"), F.when(due, steps).otherwise(0).cast("long").alias("missed"), F.when(due, F.col("next_due") + (steps + 1) * F.col("interval")).otherwise(F.col("next_due")).cast("long").alias("next_due"))


def checked(results: DataFrame, most_errors: int = 3) -> DataFrame:
    """id, checks, changes, errors, avg_ms and whether a monitor goes on, over its check results (id, ms, changed, failed)."""
    out = results.groupBy("id").agg(F.count("*").alias("checks"), F.count_if("changed").alias("changes"), F.count_if("failed").alias("errors"), F.avg("ms").alias("avg_ms"))
    return out.withColumn("active", F.col("errors") <= most_errors)


def statistics(monitors: DataFrame) -> DataFrame:
    """One row over ``checked`` monitors: their number, sums of checks, changes and errors, mean latency."""
    return monitors.agg(F.count("*").alias("monitors"), F.sum("checks").alias("checks"), F.sum("changes").alias("changes"), F.sum("errors").alias("errors"), F.avg("avg_ms").alias("avg_ms"))
