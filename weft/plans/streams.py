"""Streaming queries run over the events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import shared_folder
from ..streaming import events as E

Q: dict[str, tuple] = {}


def _run(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a file source takes a folder or a pattern; the table may be one file
        return E.run_available(make(E.read_events(spark, f"{sf_dir}/event[s].parquet")), shared_folder(spark))

    return query


Q["stream_throttle"] = (_run(lambda e: E.stateful(e, E.throttle(3_600_000), "user_id")), None)
Q["stream_rate_limit"] = (_run(lambda e: E.stateful(e, E.rate_limit(1, 3), "event_type")), None)
Q["stream_breaker"] = (_run(lambda e: E.stateful(e, E.breaker(3, 0.5, 10, 86_400_000, 3_600_000, 2), "user_id", "event_type = 'error'")), None)
Q["stream_alerts"] = (_run(lambda e: E.stateful(e, E.alert_buffer(86_400_000), "user_id")), None)
Q["stream_rates"] = (_run(lambda e: E.rates(e, "1 hour", "1 hour")), None)
