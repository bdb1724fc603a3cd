"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


def with_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with its row number in ``order`` (from 1): ranges are sorted apart and counted, and counts give the offsets."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    counts = ranged.groupBy(F.col("__p").alias("p")).agg(F.count("*").alias("c")).select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    own = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return ranged.withColumn(name, own).join(counts, F.col("__p") == F.col("p")).withColumn(name, (F.col(name) + F.col("o")).cast("long")).drop("__p", "p", "o")


def with_running(df: DataFrame, order: list[Column], value: str, name: str = "running", partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row in ``order``: ranges are summed apart, and their sums give the offsets."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    sums = ranged.groupBy(F.col("__p").alias("p")).agg(F.sum(value).alias("c")).select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    own = F.sum(value).over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, own).join(sums, F.col("__p") == F.col("p")).withColumn(name, F.col(name) + F.col("o")).drop("__p", "p", "o")
