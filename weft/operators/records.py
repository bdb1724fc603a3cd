"""Jobs, snapshots and retries as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import with_running

#: Statuses and messages that are worth another try.
RETRY_STATUS = [408, 429, 500, 502, 503, 504]
RETRY_CODES = ["ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN"]
RETRY_TEXTS = ["timeout", "ETIMEDOUT", "socket hang up", "Circuit breaker is OPEN"]


def ready(jobs: DataFrame) -> DataFrame:
    """Pending jobs (id, status, dependencies) all of whose dependencies are completed, highest priority first."""
    needs = jobs.where("status = 'PENDING'").select("id", F.explode("dependencies").alias("need"))
    open_ = needs.join(jobs.where("status = 'COMPLETED'").select(F.col("id").alias("need")), "need", "left_anti").select("id").distinct()
    return jobs.where("status = 'PENDING'").join(open_, "id", "left_anti").orderBy(F.col("priority").desc(), "created_at", "id")


def tagged(jobs: DataFrame, tag: str) -> DataFrame:
    return jobs.where(F.array_contains("tags", tag))


def expired(jobs: DataFrame, now_ms: int) -> DataFrame:
    return jobs.where(F.col("status").isin("PENDING", "RUNNING") & (F.col("created_at") + F.col("ttl") < now_ms))


def store_snapshots(snapshots: DataFrame) -> DataFrame:
    """With id, hash and length of the content; Parquet compresses it."""
    content = F.coalesce("content", F.lit(""))
    digest = F.sha2(content, 256)
    return snapshots.withColumns({"id": F.substring(F.sha2(F.concat_ws("|", "url", F.col("timestamp").cast("string")), 256), 1, 16), "content_hash": digest, "content_length": F.octet_length(content)})


def query_snapshots(snapshots: DataFrame, url: str | None = None, start: int | None = None, end: int | None = None, content_type: str | None = None, size: tuple[int, int] | None = None, sort: str = "timestamp", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0 or sort not in ("timestamp", "content_length"):
        raise ValueError("limit is 1 to 1000, offset not negative, sort timestamp or content_length")
    for test in (url and F.col("url") == url, start is not None and F.col("timestamp") >= start, end is not None and F.col("timestamp") <= end, content_type and F.col("content_type") == content_type, size and F.col("content_length").between(*size)):
        if test is not None and not isinstance(test, (bool, str)):
            snapshots = snapshots.where(test)
    key = F.col(sort).desc() if descending else F.col(sort)
    return snapshots.drop("content").orderBy(key, "id").offset(offset).limit(limit)


def delete_snapshots(snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    return snapshots.join(ids, "id", "left_anti")


def retained(snapshots: DataFrame, now_ms: int, most: int = 100, days: float = 30, bytes_: int = 1 << 30) -> DataFrame:
    """The newest ``most`` of each url that are young enough, and of those the newest that together fit the size.

    The size is a running sum over ranges of time, so no task sorts all snapshots.
    """
    mine = W.partitionBy("url").orderBy(F.col("timestamp").desc(), "id")
    kept = snapshots.withColumn("nth", F.row_number().over(mine)).where((F.col("nth") <= most) & (F.col("timestamp") >= now_ms - days * 86_400_000)).drop("nth")
    return with_running(kept, [F.col("timestamp").desc(), F.col("id")], "content_length", "__held").where(F.col("__held") <= bytes_).drop("__held")


def backoff(attempt: Column, strategy: str = "exponential", base_ms: float = 1000, most_ms: float = 30_000) -> Column:
    """Delay before attempt n (from 0): linear, exponential, fibonacci or fixed, held to ``most_ms``."""
    fib = F.aggregate(F.sequence(F.lit(0), attempt), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["a"])
    delay = {"linear": base_ms * (attempt + 1), "exponential": base_ms * F.pow(F.lit(2.0), attempt), "fibonacci": base_ms * fib, "fixed": F.lit(base_ms)}[strategy]
    return F.least(delay.cast("double"), F.lit(float(most_ms)))


def retryable(code: Column, status: Column, message: Column) -> Column:
    texts = F.greatest(*(F.contains(message, F.lit(t)) for t in RETRY_TEXTS))
    return F.when(code.isin(*RETRY_CODES), True).when(status.isNotNull(), status.isin(*RETRY_STATUS)).otherwise(F.coalesce(texts, F.lit(False)))


def health(levels: Column) -> Column:
    """Worst of healthy, warning and unhealthy in an array."""
    return F.when(F.array_contains(levels, "unhealthy"), "unhealthy").when(F.array_contains(levels, "warning"), "warning").otherwise("healthy")


def pacing(avg_ms: Column) -> dict[str, Column]:
    """Delay, concurrency and requests a minute by mean latency."""
    band = lambda a, b, c: F.when(avg_ms < 500, a).when(avg_ms < 2000, b).otherwise(c)
    return {"delay_ms": band(500, 1000, 2000), "concurrency": band(5, 3, 1), "requests_per_minute": band(60, 30, 15)}
