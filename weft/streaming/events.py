"""Structured Streaming over events: windowed rates, and keyed state for throttles, rate limits, breakers and alert buffers.

State machines are plain functions (state, time, row) -> (state, outputs); ``stateful`` runs one of them over each
key in event-time order within a micro-batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files with the schema that they have now; timestamps get the UTC zone."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rates(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Rows, rate a second and mean value by sliding window and key; rows later than the watermark are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "avg_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


Step = Callable[[dict, float, dict], tuple[dict, list[dict]]]


def throttle(every_ms: float) -> Step:
    """A row passes if none passed within ``every_ms`` before it."""

    def step(state: dict, ms: float, row: dict):
        if "last" in state and ms - state["last"] < every_ms:
            return state, []
        return {"last": ms}, [{"detail": "sent"}]

    return step


def rate_limit(per_second: int, per_minute: int) -> Step:
    """Two fixed windows, each from its first row: rows within both limits are allowed."""

    def step(state: dict, ms: float, row: dict):
        s, m = state.get("s", [ms, 0]), state.get("m", [ms, 0])
        s = [ms, 0] if ms - s[0] >= 1000 else s
        m = [ms, 0] if ms - m[0] >= 60_000 else m
        ok = s[1] < per_second and m[1] < per_minute
        if ok:
            s, m = [s[0], s[1] + 1], [m[0], m[1] + 1]
        return {"s": s, "m": m}, [{"detail": "allowed" if ok else "limited"}]

    return step


def breaker(failures: int = 5, share: float = 0.5, least: int = 10, window_ms: float = 60_000, rest_ms: float = 60_000, probes: int = 3) -> Step:
    """Closed until ``failures`` in a row or ``share`` of ``least`` calls in the window fail; open for ``rest_ms``; then probes."""

    def step(state: dict, ms: float, row: dict):
        mode, since, run, calls, good = (state.get(k, d) for k, d in (("mode", "closed"), ("since", ms), ("run", 0), ("calls", []), ("good", 0)))
        failed = bool(row["failed"])
        if mode == "open" and ms - since >= rest_ms:
            mode, good = "half_open", 0
        if mode == "open":
            return state, [{"detail": "rejected"}]
        calls = [c for c in calls if ms - c[0] < window_ms] + [[ms, failed]]
        run = run + 1 if failed else 0
        if mode == "half_open":
            good = 0 if failed else good + 1
            mode, since = ("open", ms) if failed else ("closed", ms) if good >= probes else (mode, since)
            if mode == "closed":
                run, calls = 0, []
        elif run >= failures or len(calls) >= least and sum(f for _, f in calls) / len(calls) >= share:
            mode, since = "open", ms
        return {"mode": mode, "since": since, "run": run, "calls": calls, "good": good}, [{"detail": mode}]

    return step


def alert_buffer(every_ms: float = 300_000) -> Step:
    """Rows gather from the first on; the first row after ``every_ms`` flushes their number and starts anew."""

    def step(state: dict, ms: float, row: dict):
        if "first" in state and ms - state["first"] > every_ms:
            return {"first": ms, "n": 1}, [{"detail": f"flushed {state['n']}"}]
        return {"first": state.get("first", ms), "n": state.get("n", 0) + 1}, []

    return step


def stateful(events: DataFrame, step: Step, key: str, failed: str = "false", late: str = "10 minutes", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Outputs (key, event_id, detail) of a state machine by key, rows of a micro-batch in order of time and id.

    A key's rows of one micro-batch are sorted in memory; ``maxFilesPerTrigger`` bounds a micro-batch.  The state of a
    key goes once the watermark is ``idle_ms`` past its last row.
    """
    rows = events.withWatermark("ts", late).select("ts", F.col(key).cast("string").alias("key"), F.col("event_id"), (F.unix_micros("ts") / 1000).alias("ms"), F.expr(failed).alias("failed"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if held.hasTimedOut:
            held.remove()
        else:
            state = json.loads(held.get[0]) if held.exists else {}
            batch = pd.concat([f[["ms", "event_id", "failed"]] for f in frames]).sort_values(["ms", "event_id"])
            for ms, event_id, bad in batch.itertuples(index=False, name=None):
                state, made = step(state, ms, {"failed": bad})
                out += [(k[0], event_id, m["detail"]) for m in made]
            held.update((json.dumps(state),))
            held.setTimeoutTimestamp(max(int(batch["ms"].iloc[-1]), held.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["key", "event_id", "detail"])

    return rows.groupBy("key").applyInPandasWithState(run, "key string, event_id long, detail string", "state string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet under ``folder`` and return the written rows."""
    spark, path = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
