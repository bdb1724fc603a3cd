"""Rendezvous (highest random weight) sharding of stable keys over weighted shards, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

def uniform(key: Column, shard: int, seed: str = "") -> Column:
    """A number in (0, 1) from the first 52 bits of md5(seed|key|shard)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key, F.lit(f"|{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float], seed: str = "") -> Column:
    """Index of the shard with the highest score -w / ln(u); the first of equal scores.

    A shard's score depends on the key and on that shard alone: adding a shard moves to it the keys it
    wins and no others, and raising a weight pulls keys towards that shard only.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = F.array(*(F.lit(-float(w)) / F.ln(uniform(key, i, seed)) for i, w in enumerate(weights)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def assign_shards(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0, seed: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard every row by its key; number the rows of each shard; tell its shard after growth by one.

    Returns key, size (UTF-8 bytes of the text plus 8), text_crc32, law ('key'), shard, slot, grown_shard.

    * A null key counts as one more key; a null text has size 8 and the checksum of no bytes, as the empty text.
    * Rows with the same key share a shard.  Rows alike in key, size and checksum get consecutive slots in any
      order, which no output shows.  No rows give an empty result.  Other columns of the input are not read.
    * A shard's rows are numbered in 4096 hashed parts (three hex digits) whose sizes are summed first, so neither a
      hot shard nor a large corpus puts a shard into one task.  Rows alike in all that is returned are counted before
      they move and numbered from their count, so copies in any number are one row until the end.
    """
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    stable = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    scores = F.array(*(F.lit(-float(w)) / F.ln(uniform(stable, i, seed)) for i, w in enumerate([*weights, grown_weight])))
    best = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    rows = (
        docs.select(F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), scores.alias("scores"))
        .withColumn("shard", best(F.slice("scores", 1, n_shards)))
        .withColumn("grown_shard", best(F.col("scores")))
        .withColumn("part", F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("null")), "size", "text_crc32")), 1, 3))
        .drop("scores")
    )
    rows = materialize(rows, "shards")
    alike = rows.groupBy("shard", "part", "key", "size", "text_crc32", "grown_shard").agg(F.count("*").alias("copies"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    parts = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "part").orderBy("key", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = alike.withColumn("nth", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(parts, ["shard", "part"])
    first = F.col("offset") + F.col("nth")
    out = placed.withColumn("slot", F.explode(F.sequence(first, first + F.col("copies") - 1)))
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
