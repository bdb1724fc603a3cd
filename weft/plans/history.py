"""Queries over events as snapshots and metric samples: windows, retention, as-of merge, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators.ranks import with_rank
from ..sources.tables import table

Q: dict[str, tuple] = {}


def micros(col: str) -> Column:
    """Microseconds from 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("ms", micros("ts") / 1000)


def _by_user(desc: bool = False):
    order = [F.col("ts").desc(), F.col("event_id").desc()] if desc else ["ts", "event_id"]
    return W.partitionBy("user_id").orderBy(*order)


def _lag(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    w = _by_user()
    prev, last = F.lag("ms").over(w), F.lag("value").over(w)
    size = F.when(F.greatest(F.abs("value"), F.abs(last)) > 0, 1 - F.abs(F.col("value") - last) / F.greatest(F.abs("value"), F.abs(last))).otherwise(1.0)
    return e.select("event_id", (F.col("ms") - prev).alias("time_delta"), F.round(F.col("value") - last, 6).alias("size_delta"), F.round(F.when(last.isNotNull(), size), 6).alias("size_similarity"), (F.col("event_type") != F.lag("event_type").over(w)).alias("type_changed"))


Q["history_lag"] = (
    _lag,
    """select event_id, ms - pm as time_delta, round(value - pv, 6) as size_delta, round(case when pv is not null then case when greatest(abs(value), abs(pv)) > 0 then 1 - abs(value - pv) / greatest(abs(value), abs(pv)) else 1 end end, 6) as size_similarity, event_type <> pt as type_changed
from (select *, lag(ms) over w as pm, lag(value) over w as pv, lag(event_type) over w as pt from (select *, epoch_us(ts) / 1000 as ms from events) window w as (partition by user_id order by ts, event_id))""",
)
Q["average_interval"] = (
    lambda s, d: events(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") > 1, (F.max("ms") - F.min("ms")) / (F.count("*") - 1)), 3).alias("avg_interval")),
    "select user_id, count(*) as n, round(case when count(*) > 1 then (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000 / (count(*) - 1) end, 3) as avg_interval from events group by user_id",
)
_LEVEL = "case when value < 20 then 'none' when value < 40 then 'minor' when value < 60 then 'moderate' when value < 80 then 'major' else 'critical' end"


def _distribution(s: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("value") < 20, "none").when(F.col("value") < 40, "minor").when(F.col("value") < 60, "moderate").when(F.col("value") < 80, "major").otherwise("critical")
    return events(s, d).groupBy("user_id").agg(*(F.sum((level == k).cast("long")).alias(k) for k in L.LEVELS), F.sum(((F.array_position(F.array(*map(F.lit, L.LEVELS)), level)) >= 3).cast("long")).alias("at_least_moderate"))


Q["significance_distribution"] = (_distribution, "select user_id, " + ", ".join(f"count(*) filter (where {_LEVEL} = '{k}') as {k}" for k in L.LEVELS) + f", count(*) filter (where {_LEVEL} in ('moderate', 'major', 'critical')) as at_least_moderate from events group by user_id")
Q["retention"] = (
    lambda s, d: events(s, d).withColumns({"nth": F.row_number().over(_by_user(True)), "held": F.sum("value").over(_by_user(True).rowsBetween(W.unboundedPreceding, 0))}).where("nth <= 20 and ts >= timestamp_ntz'2024-01-10 00:00:00' and held <= 1500").select("event_id", "user_id", "nth"),
    "select event_id, user_id, nth::int as nth from (select *, row_number() over w as nth, sum(value) over (partition by user_id order by ts desc, event_id desc rows between unbounded preceding and current row) as held from events window w as (partition by user_id order by ts desc, event_id desc)) where nth <= 20 and ts >= timestamp '2024-01-10 00:00:00' and held <= 1500",
)
Q["running_average"] = (
    lambda s, d: events(s, d).select("event_id", F.round(F.sum("value").over(_by_user().rowsBetween(W.unboundedPreceding, 0)), 4).alias("running_sum"), F.count("*").over(_by_user().rowsBetween(W.unboundedPreceding, 0)).alias("running_n")),
    "select event_id, round(sum(value) over w, 4) as running_sum, count(*) over w as running_n from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)",
)


def merge_history(changes: DataFrame, snapshots: DataFrame, within_ms: int = 60_000) -> DataFrame:
    """Changes with the snapshot within a minute, and snapshots that no change matches, by user.

    A range join: both sides meet in the minute bucket and its neighbours, and the first change (latest, then
    smallest id) takes a snapshot.
    """
    bucket = lambda c: F.floor(F.col(c) / within_ms)
    a = changes.select("user_id", F.col("event_id").alias("change_id"), F.col("ms").alias("change_ms"), F.explode(F.array(bucket("ms") - 1, bucket("ms"), bucket("ms") + 1)).alias("bucket"))
    b = snapshots.select("user_id", F.col("event_id").alias("snapshot_id"), F.col("ms").alias("snapshot_ms"), bucket("ms").alias("bucket"))
    hits = b.join(a, ["user_id", "bucket"]).where(F.abs(F.col("change_ms") - F.col("snapshot_ms")) < within_ms)
    best = hits.withColumn("nth", F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.col("change_ms").desc(), "change_id"))).where("nth = 1").select("snapshot_id", "change_id")
    matched = best.groupBy("change_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    own = changes.select(F.col("event_id").alias("change_id"), "user_id", "ms").join(matched, "change_id", "left")
    alone = b.join(best, "snapshot_id", "left_anti").select(F.lit(None).cast("long").alias("change_id"), "user_id", F.col("snapshot_ms").alias("ms"), "snapshot_id")
    return own.unionByName(alone).withColumn("source", F.when(F.col("change_id").isNull(), "snapshot").otherwise("change_tracker")).withColumn("has_snapshot", F.col("snapshot_id").isNotNull())


Q["history_merge"] = (
    lambda s, d: merge_history(events(s, d).where("event_type = 'click'"), events(s, d).where("event_type = 'view'"), 600_000),
    """with e as (select *, epoch_us(ts) / 1000 as ms from events), c as (select * from e where event_type = 'click'), v as (select * from e where event_type = 'view'),
h as (select v.event_id as snapshot_id, c.event_id as change_id, row_number() over (partition by v.event_id order by c.ms desc, c.event_id) as nth from v join c on v.user_id = c.user_id and abs(v.ms - c.ms) < 600000),
b as (select snapshot_id, change_id from h where nth = 1), m as (select change_id, max(snapshot_id) as snapshot_id from b group by change_id)
select c.event_id as change_id, user_id, ms, snapshot_id, 'change_tracker' as source, snapshot_id is not null as has_snapshot from c left join m on c.event_id = m.change_id
union all select null, user_id, ms, event_id, 'snapshot', true from v where event_id not in (select snapshot_id from b)""",
)


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values at floor(n * p) of each group in order, found by rank over ranges, so no task holds a group."""
    tie = F.monotonically_increasing_id()  # parts equal values; which of them comes first does not show
    ranked = with_rank(rows.select(key, value, tie.alias("__tie")), [F.col(key), F.col(value), F.col("__tie")], "r")
    groups = ranked.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.min("r").alias("first"))
    placed = ranked.join(groups, F.col(key) == F.col("k")).withColumn("r", F.col("r") - F.col("first"))
    return placed.groupBy(key).agg(*(F.max(F.when(F.col("r") == F.floor(F.col("n") * p), F.col(value))).alias(f"p{int(round(p * 100))}") for p in (0.5, 0.75, 0.9, 0.95, 0.99)))


Q["latency_percentiles"] = (
    lambda s, d: percentiles(events(s, d), "event_type", "value"),
    "select event_type, " + ", ".join(f"max(value) filter (where r = floor(n * {p}::double)) as p{int(round(p * 100))}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)) + " from (select *, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as n from events) group by event_type",
)
Q["tool_metrics"] = (
    lambda s, d: events(s, d).withColumn("err", F.col("value") > 90).groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.col("err").cast("long")).alias("errors"), F.round(F.avg(F.col("err").cast("double")), 6).alias("error_rate"), F.round(F.avg("value"), 6).alias("avg_value"), F.max_by("event_id", "ts").alias("last_event")),
    "select event_type, count(*) as calls, count(*) filter (where value > 90) as errors, round(avg((value > 90)::int), 6) as error_rate, round(avg(value), 6) as avg_value, max_by(event_id, ts) as last_event from events group by event_type",
)
_B = "case when value * 50 < 100 then '0-100ms' when value * 50 < 500 then '100-500ms' when value * 50 < 1000 then '500ms-1s' when value * 50 < 2000 then '1-2s' when value * 50 < 5000 then '2-5s' else '5s+' end"
Q["response_buckets"] = (lambda s, d: events(s, d).groupBy(F.expr(_B).alias("bucket")).agg(F.count("*").alias("n")), f"select {_B} as bucket, count(*) as n from events group by 1")
Q["cumulative_histogram"] = (
    lambda s, d: events(s, d).groupBy("event_type").agg(*(F.sum((F.col("value") * 50 <= b).cast("long")).alias(f"le_{b}") for b in L.LATENCY_BOUNDS), F.count("*").alias("n"), F.round(F.sum(F.col("value") * 50), 4).alias("total")),
    "select event_type, " + ", ".join(f"count(*) filter (where value * 50 <= {b}) as le_{b}" for b in L.LATENCY_BOUNDS) + ", count(*) as n, round(sum(value * 50), 4) as total from events group by event_type",
)
Q["sliding_rates"] = (
    lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")).select(micros("w.start").alias("start_us"), "event_type", "n", "avg_value"),
    "select start_us, event_type, count(*) as n, round(avg(value), 6) as avg_value from (select event_type, value, unnest([epoch_us(ts) // 900000000 * 900000000 - i * 900000000 for i in range(4)]) as start_us from events) group by all",
)
Q["session_windows"] = (
    lambda s, d: table(s, d, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select(micros("w.start").alias("start_us"), "user_id", "n"),
    """select min(epoch_us(ts)) as start_us, user_id, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as sess from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as new from events)) group by user_id, sess""",
)
Q["event_properties"] = (
    lambda s, d: table(s, d, "events").select("event_type", F.variant_get(F.try_parse_json("props"), "$.k", "long").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total")),
    "select event_type, count(k) as n, sum(k)::bigint as total from (select event_type, json_extract(props, '$.k')::bigint as k from events) group by event_type",
)
Q["job_status"] = (
    lambda s, d: events(s, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("failures")),
    "select user_id, max_by(event_type, (ts, event_id)) as status, count(*) filter (where event_type = 'error') as failures from events group by user_id",
)
