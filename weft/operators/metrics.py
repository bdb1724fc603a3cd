"""Sinks and summaries of call metrics: Prometheus text, CSV lines, one row of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L

#: Upper bounds of the histogram that is rendered.
BOUNDS = L.LATENCY_BOUNDS


def prometheus(calls: DataFrame, name: str, value: str, failed: str, prefix: str = "weft") -> DataFrame:
    """A column of lines: calls, errors, and a cumulative histogram with its count, for each name."""
    totals = calls.groupBy(name).agg(F.count("*").alias("n"), F.count_if(failed).alias("f"), *(F.count_if(F.col(value) <= b).alias(f"b{b}") for b in BOUNDS))
    label = F.concat(F.lit('{name="'), F.col(name), F.lit('"'))
    line = lambda metric, count, more="": F.concat(F.lit(f"{prefix}_{metric}"), label, F.lit(f"{more}}} "), F.col(count).cast("string"))
    lines = [line("calls_total", "n"), line("errors_total", "f"), *(line("duration_bucket", f"b{b}", f',le="{b}"') for b in BOUNDS), line("duration_bucket", "n", ',le="+Inf"'), line("duration_count", "n")]
    return totals.select(F.explode(F.array(*lines)).alias("line"))


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A column of lines, one for each row."""
    return rows.select(F.to_csv(F.struct(*columns)).alias("line"))


def summary(calls: DataFrame, name: str, value: str, failed: Column) -> DataFrame:
    """One row: calls, error rate, calls a second, the most used name, mean value."""
    per = calls.groupBy(name).agg(F.count("*").alias("n"), F.count_if(failed).alias("f"), F.sum(value).alias("s"), F.min("ms").alias("first"), F.max("ms").alias("last"))
    return per.agg(
        F.sum("n").alias("calls"), F.round(F.sum("f") / F.sum("n"), 6).alias("error_rate"), F.round(F.sum("n") / F.greatest(F.lit(1), (F.max("last") - F.min("first")) / 1000), 6).alias("per_second"),
        F.min_by(name, F.struct(-F.col("n"), name)).alias("most_used"), F.round(F.sum("s") / F.sum("n"), 6).alias("avg_value"),
    )


def in_range(series: DataFrame, column: str, start, end) -> DataFrame:
    """Rows of a time series from ``start`` to ``end``, both included."""
    return series.where(F.col(column).between(start, end))


def service_metrics(calls: DataFrame, name: str, failed: Column, at: str, window_ms: int) -> DataFrame:
    """name, calls, failures, successes and error rate in per cent of the calls within a window before the last of all."""
    last = calls.agg(F.max(at).alias("m")).scalar()
    recent = calls.where(F.col(at) >= last - window_ms)
    out = recent.groupBy(name).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    return out.select(name, "calls", "failures", (F.col("calls") - F.col("failures")).alias("successes"), F.round(100 * F.col("failures") / F.col("calls"), 4).alias("error_rate"))
