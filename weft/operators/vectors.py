"""Nearest rows by cosine: blocks of queries go to where the rows lie, as matrix products."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import spread
from .lineage import cut

#: Rows of a chunk that a task scores at once, and bytes of a block of queries, which every task gets.
CHUNK, BLOCK_BYTES = 20_000, 8 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    width = set(pc.list_value_length(column).to_pylist())
    if len(width) > 1:
        raise ValueError("vectors differ in length")
    m = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width.pop() if width else 0)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    left = np.arange(len(ids))
    if len(ids) > k:
        left = left[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return left[np.lexsort((ids[left], -scores[left]))][:k]


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES, digits: int = 6) -> DataFrame:
    """q, vec_id, score, rank: the k most similar other rows of each query row, ties to smaller ids; zero vectors score 0.

    Vectors that are null or hold null or non-finite components take no part; vectors of unlike length raise an error.
    Rows stay where they lie: blocks of queries of about ``block_bytes`` go to all tasks one after another.
    """
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    data = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & good).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asks = data.where("asks").select("id", "v").distinct()
    n = asks.agg(F.sum(8 * F.size("v") + 32).alias("b")).first()["b"] or 0
    blocks, out, held = max(1, math.ceil(n / block_bytes)), None, spread(data.select("id", "v"))
    for b in range(blocks):
        block = asks.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        vectors = block.column("v").combine_chunks() if block.num_rows else None
        sent = rows.sparkSession.sparkContext.broadcast((np.asarray(block.column("id")), _matrix(vectors) if vectors is not None else None))

        def run(batches, sent=sent):
            own, m = sent.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)

            def take(held_rows: list[pa.RecordBatch]) -> None:
                ids = np.concatenate([np.asarray(x.column(0)) for x in held_rows])
                scores = np.round(m @ _matrix(pa.concat_arrays([x.column(1) for x in held_rows])).T, digits)
                for i, q in enumerate(own.tolist()):
                    at = np.flatnonzero(ids != q)
                    at = at[_best(ids[at], scores[i, at], k)]
                    both_ids, both = np.concatenate([best[i][0], ids[at]]), np.concatenate([best[i][1], scores[i, at]])
                    at = _best(both_ids, both, k)
                    best[i] = both_ids[at], both[at]

            held_rows, size = [], 0
            for batch in batches:
                if len(own) and batch.num_rows:
                    held_rows.append(batch)
                    size += batch.num_rows
                if size >= chunk:
                    take(held_rows)
                    held_rows, size = [], 0
            if held_rows:
                take(held_rows)
            n = [len(x) for x, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n), pa.int64()), pa.array(np.concatenate([x for x, _ in best]) if n else [], pa.int64()), pa.array(np.concatenate([x for _, x in best]) if n else [], pa.float64())], ["q", "vec_id", "score"])

        mine = held.mapInArrow(run, "q long, vec_id long, score double")
        mine = mine.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
        mine = mine if blocks == 1 else cut(mine)
        out = mine if out is None else out.unionByName(mine)
    return out
