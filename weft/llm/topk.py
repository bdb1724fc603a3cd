"""Exact top-k by inner product: term-at-a-time accumulation into dense score arrays, then a merge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import counted, materialize, spread

#: Rows of a candidate chunk that a task scores at once, and bytes of a block of queries, which every task gets.
CHUNK, BLOCK_BYTES = 40_000, 8 << 20


def quantise(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null or non-finite component."""
    good = vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every nonzero component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    values = np.asarray(column.flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    return row[some], term[some], values[some]


def best_of_chunk(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a chunk for each query of a block.

    Each term has a postings list (rows, weights).  A query walks its own terms and adds weight times
    postings into one dense score array; a partition selection then leaves the k best, ties to smaller ids.
    """
    n, ids = rows.num_rows, np.asarray(rows.column("id").fill_null(np.iinfo(np.int64).max), dtype=np.int64)
    own, term, weight = _entries(rows.column("v"))
    order = np.argsort(term, kind="stable")
    own, term, weight = own[order], term[order], weight[order]
    top = int(term[-1]) + 1 if len(term) else 0
    cut = np.searchsorted(term, np.arange(top + 1))
    postings = [(own[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    q_row, q_term, q_weight = _entries(queries.column("v"))
    q_cut = np.searchsorted(q_row, np.arange(queries.num_rows + 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    q_ids = queries.column("id").to_pylist()
    scores = np.zeros(n, np.int64)
    for q, q_id in enumerate(q_ids):
        scores[:] = 0
        for t, w in zip(q_term[q_cut[q] : q_cut[q + 1]], q_weight[q_cut[q] : q_cut[q + 1]]):
            if t < top:
                at, held = postings[t]
                if len(at) == n:
                    scores += w * held
                else:
                    scores[at] += w * held
        left = np.flatnonzero(ids != q_id)
        if len(left) > k:
            s = scores[left]
            least = np.partition(s, len(s) - k)[len(s) - k]
            left = left[s >= least]
        left = left[np.lexsort((ids[left], -scores[left]))][:k]
        found.append((left, scores[left].copy()))
    took = [len(a) for a, _ in found]
    at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    return pa.table({
        "q": pa.array(np.repeat(np.asarray(queries.column("q"), dtype=np.int64), took), pa.int64()),
        "query_id": pa.array(np.repeat(np.asarray(q_ids, dtype=np.int64), took), pa.int64()),
        "vec_id": rows.column("id").combine_chunks().take(pa.array(at, pa.int64())) if n else pa.array([], pa.int64()),
        "score": pa.array(np.concatenate([s for _, s in found]) if found else [], pa.int64()),
    })


def _kept(found: list[pa.Table], k: int) -> pa.Table:
    """The k best of each query over the chunks of one task."""
    both = pa.concat_tables(found)
    if len(found) < 2:
        return both
    q, score = np.asarray(both.column("q")), np.asarray(both.column("score"))
    ids = np.asarray(both.column("vec_id").fill_null(np.iinfo(np.int64).max))
    order = np.lexsort((ids, -score, q))
    first = np.flatnonzero(np.diff(q[order], prepend=q[order][:1] - 1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return both.take(pa.array(order[nth < k]))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row that ``is_query`` marks, the k rows of the highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, null last.

    * Vectors that are null or hold null or non-finite components take no part; empty vectors score 0.  Vectors
      of unlike length meet in their common components.  Scores are 64-bit integers.
    * A query never finds rows with its own id.  Query rows alike in id and vector are answered once.
    * Candidates stay where they lie.  The distinct queries, dealt by hash into blocks of about ``block_bytes``, go
      to all tasks one block after another; a task scores its rows ``chunk`` by chunk and passes on its k best for each
      query, which a shuffle by query merges.  No rows give an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantise(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    asks, seen = counted(rows.where("asks").select("id", "v").distinct().withColumn("q", F.xxhash64("id", "v")), "queries", F.sum(8 * F.size("v") + 64).alias("bytes"))
    blocks, answers = max(1, math.ceil((seen["bytes"] or 0) / block_bytes)), None
    held = spread(rows.select("id", "v"))
    for b in range(blocks):
        block = asks.where(F.pmod("q", F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(_packed(block))

        def run(batches, sent=sent):
            queries = _unpacked(sent.value)
            found, held_rows, n = [], [], 0
            for batch in batches:
                held_rows.append(pa.Table.from_batches([batch]))
                n += batch.num_rows
                if n >= chunk:
                    found = [_kept([*found, best_of_chunk(queries, pa.concat_tables(held_rows), k)], k)]
                    held_rows, n = [], 0
            if n:
                found = [_kept([*found, best_of_chunk(queries, pa.concat_tables(held_rows), k)], k)]
            yield from (x for t in found for x in t.to_batches())

        mine = held.mapInArrow(run, "q long, query_id long, vec_id long, score long")
        best = W.partitionBy("query_id", "q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        mine = mine.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        mine = mine if blocks == 1 else materialize(mine, "answers")
        answers = mine if answers is None else answers.unionByName(mine)
    return answers


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()
