"""Shared plumbing: table access, shared-folder materialisation, UTF-8 views of Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer splits than cores; a large table has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a temporary folder serves, but only in local mode, where there is one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="weft-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Frees the shuffle files of a query as it ends; without it they lie on the executors until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, observation: Observation | None = None, *metrics: Column) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Cuts lineage, so a lost executor costs a reread and not a recomputation.  ``metrics`` are observed on the way.
    The files go when ``discard`` names them or the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.observe(observation, *metrics) if observation is not None else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    target, files = _located(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["weft_path"] = path
    return out


def counted(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and the number of rows (n) with other metrics, without another scan."""
    seen = Observation()
    out = materialize(df, label, seen, F.count(F.lit(1)).alias("n"), *metrics)
    return out, seen.get


#: Keys with more than this share of all rows are joined by a broadcast: there are at most as many of them.
HEAVY = 10_000
#: Up to this many rows one key is no burden, whatever its share.
FEW = 1 << 20


def join_heavy(rows: DataFrame, lookup: DataFrame, key: str, total: int, count: str) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) to ``lookup``, which has one row for each key and how many rows have it.

    No task gets all rows of a heavy key: the at most ``HEAVY`` keys with over 1/``HEAVY`` of the rows each are broadcast
    to their rows, the others meet by a shuffle.
    """
    if total <= FEW:
        return rows.join(lookup.drop(count), key)
    heavy = F.col(count) * HEAVY > total
    hot = F.broadcast(lookup.where(heavy).drop(count))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(lookup.where(~heavy).drop(count), key))


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    path = df.__dict__.get("weft_path") if df is not None else None
    if path:
        target, files = _located(df.sparkSession, path)
        files.delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that no column of ``df`` has."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns of its own called as one of ``names`` renamed to ``input_<name>``, so that results have the name."""
    for name in names:
        own = next((c for c in df.columns if c.lower() == name.lower()), None)
        if own is not None:
            away = f"input_{own}"
            while away.lower() in {c.lower() for c in df.columns}:
                away = f"input_{away}"
            df = df.withColumnRenamed(own, away)
    return df


def source_order(col) -> list:
    """Sort keys: code point order of a string column, null last."""
    return [F.col(col).isNull(), F.col(col)]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and their offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Rows of an Arrow batch of texts: bounds what the JVM, the socket and the worker hold of one batch.
BATCH_ROWS = 512


def release() -> None:
    """Give freed memory back: workers outlive their task, and several wait beside the ones at work."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over rows with texts, in batches of ``BATCH_ROWS`` rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "0")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def slices(batches, column: str, most: int = 1 << 20):
    """Cut record batches so that each piece holds at most ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits of a row's id and text, null told from empty, as two longs."""
    parts = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def one_of_alike(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``: of rows that differ elsewhere the one with the least hash of its columns.

    Columns of types that have no hash (maps) do not take part in the choice.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in keys and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in keys))
    return docs.groupBy(*keys).agg(F.min_by(whole, F.xxhash64(*hashed)).alias("w")).select(*keys, "w.*")


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and document index of every word of concatenated texts."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    change = inside[1:] != inside[:-1]
    starts = np.flatnonzero(change[:-1] & inside[1:-1])
    ends = np.flatnonzero(change & ~inside[1:])
    cuts = at[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a text ends inside a run of word bytes
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    doc = np.searchsorted(at, starts, side="right") - 1
    return starts, ends, doc


_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64; kept by base, as every piece of text asks for the same ones."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[int(base)] = held
    return held[:n]


class SpanHashes:
    """64-bit polynomial hashes of byte spans; equal spans hash alike, so only collisions need a check."""

    def __init__(self, raw: np.ndarray):
        self.inverse = powers(_R_INV, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_R, len(raw)), dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
