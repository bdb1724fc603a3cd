"""Mixing sources to target weights over fixed-length token blocks.

The words of a source, document after document, form one stream that is cut into blocks of equal length.  Each output
shard has a fixed number of slots and draws how many of them each source gets from a multinomial by the sources'
shares; a pseudorandom permutation per source and pass maps a slot to a block, and slots meet blocks in a join by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, map_texts, materialize, one_of_alike, row_key, utf8, words

#: Slots that one row of the plan stands for at most.
PIECE = 1 << 16


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code point order, null last; no source is taken over ``cap`` times."""

    weights: Sequence[float] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    block: int = 256
    shards: int = 64
    seed: int = 7


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``cap`` times a size is shared again by weight."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s], [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if left * weights[i % len(weights)] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
        left, gone = left - sum(out[i] for i in over), set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1: four Feistel rounds, walked until the value is below n."""
    if n < 2:
        return index.copy()
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(_seed(seed, i)) for i in range(4)]

    def rounds(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys:
            h = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return (a << half) | b

    out = rounds(index.astype(np.uint64))
    while len(over := np.flatnonzero(out >= np.uint64(n))):
        out[over] = rounds(out[over])
    return out.astype(np.int64)


def slots_of(source: int, first: int, count: int, size: int, target: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pass, block and words taken of slots ``first`` to ``first + count`` of a source.

    A pass takes every block once: the full blocks permuted, then the last one, which may be short.  The
    slot that reaches the target takes only what is missing, so a source's words sum to its target.
    """
    blocks = -(-size // block)
    k = np.arange(first, first + count)
    turn, nth = k // blocks, k % blocks
    at = nth.copy()
    full = nth < blocks - 1
    for t in np.unique(turn[full]):
        own = full & (turn == t)
        at[own] = permute(nth[own], blocks - 1, _seed(seed, source, t))
    length = np.where(full, block, size - (blocks - 1) * block)
    before = turn * size + nth * block
    return turn, at, np.minimum(length, target - before)


def n_slots(size: int, target: int, block: int) -> int:
    if not size or not target:
        return 0
    blocks = -(-size // block)
    turns, rest = divmod(target, size)
    return turns * blocks + (blocks if rest > (blocks - 1) * block else -(-rest // block))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Each row's place in its source's stream: id, h and g (hashes of id and text), src, size, start.

    A stream is laid out in 4096 hashed parts, by id and hash within one, and part sums give the offsets,
    so no task holds a source.  Rows alike in all of these are counted first and take places one after another.
    """
    h, g = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).alias("id"), h.alias("h"), g.alias("g"), F.col(source).alias("src"), count_words(F.col(text)).alias("size"))
    rows = materialize(rows.groupBy(*rows.columns, F.pmod("h", F.lit(4096)).cast("int").alias("part")).agg(F.count("*").alias("copies")), "mix-rows")
    parts = rows.groupBy("src", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    before = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("src").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("src", "part").orderBy("id", "h", "g").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("local", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    placed = placed.join(parts, (F.col("part") == F.col("p")) & F.col("src").eqNullSafe(F.col("s")))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.select("id", "h", "g", "src", "size", (F.col("offset") + F.col("local") + F.col("nth") * F.col("size")).alias("start"))


def _spread(rng: np.random.Generator, wanted: int, room: np.ndarray) -> np.ndarray:
    """``wanted`` taken from shards in proportion to their ``room``, what is left over from shards in a random order."""
    out = np.array([int(r) * int(wanted) // max(1, int(room.sum())) for r in room], np.int64)
    order = rng.permutation(len(room))
    open_ = order[room[order] > out[order]]
    out[open_[: wanted - int(out.sum())]] += 1
    return out


def draw(slots: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Slots of each source (columns) in each output shard (rows).

    A shard of fixed size draws its counts from the multinomial of the sources' shares.  Over all shards a source then
    has somewhat more or fewer slots than its target asks; the surplus is given back by the shards that drew it,
    and the sources that lack slots get those, so every shard keeps its size and every source meets its target.
    """
    whole = int(slots.sum())
    sizes = np.array([(j + 1) * whole // shards - j * whole // shards for j in range(shards)], np.int64)
    if not whole:
        return np.zeros((shards, len(slots)), np.int64)
    drawn = np.array([rng.multinomial(n, slots / whole) for n in sizes], np.int64)
    over = drawn.sum(0) - slots
    free = np.zeros(shards, np.int64)
    for s in np.flatnonzero(over > 0):
        back = _spread(rng, int(over[s]), drawn[:, s])
        drawn[:, s] -= back
        free += back
    for s in np.flatnonzero(over < 0):
        got = _spread(rng, int(-over[s]), free)
        drawn[:, s] += got
        free -= got
    return drawn


def plan(spark: SparkSession, sizes: list[tuple[str | None, int]], mix: Mix) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the slots of each source in each output shard as pieces of a sequence.

    The driver holds a row for each source with a count for each shard (some 600 bytes), no more.
    """
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([n for _, n in sizes], mix.weights, mix.share, mix.cap)
    words_ = [min(int(np.floor(t + 0.5)), int(mix.cap * n)) for (_, n), t in zip(sizes, wanted)]
    slots = np.array([n_slots(n, w, mix.block) for (_, n), w in zip(sizes, words_)], np.int64)
    drawn = draw(slots, mix.shards, np.random.default_rng(mix.seed))
    first, base, held = np.cumsum(drawn, 0) - drawn, np.cumsum(drawn, 1) - drawn, drawn.sum(1)
    sources = spark.createDataFrame([(i, name, int(n), float(t)) for i, ((name, n), t) in enumerate(zip(sizes, wanted))], "s int, name string, source_size long, target double")
    rows = [(i, int(n), w, [(j, int(first[j, i]), int(drawn[j, i]), int(base[j, i]), int(held[j])) for j in range(mix.shards) if drawn[j, i]]) for i, ((_, n), w) in enumerate(zip(sizes, words_))]
    pieces = spark.createDataFrame(rows, "s int, size long, words long, p array<struct<shard: int, first: long, n: long, base: long, held: long>>")
    return sources, pieces.select("s", "size", "words", F.explode("p").alias("p")).select("s", "size", "words", "p.*")


def slot_table(pieces: DataFrame, mix: Mix) -> DataFrame:
    """One row for each slot of the mix: shard, slot in the shard, source, pass, block, words taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                turn, at, taken = slots_of(r["s"], r["first"], r["n"], r["size"], r["words"], mix.block, mix.seed)
                slot = permute(np.arange(r["base"], r["base"] + r["n"]), r["held"], _seed(mix.seed, "shard", r["shard"]))
                n = len(turn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"]), pa.int32()), pa.array(slot, pa.int64()), pa.array(np.full(n, r["s"]), pa.int32()), pa.array(turn, pa.int32()), pa.array(at, pa.int64()), pa.array(taken, pa.int64())], ["shard", "slot", "s", "turn", "block", "taken"])

    cut = pieces.select("s", "size", "words", "shard", "held", "first", "base", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    cut = cut.select("s", "size", "words", "shard", "held", (F.col("first") + F.col("from")).alias("first"), (F.col("base") + F.col("from")).alias("base"), F.least(F.col("n") - F.col("from"), F.lit(PIECE)).alias("n"))
    return cut.repartition("s", "shard", "first").mapInArrow(run, "shard int, slot long, s int, turn int, block long, taken long")


def mix_spans(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mix as spans of documents, and the documents it draws on.

    Spans: shard, slot, turn (0 for the first pass over a source), block, s, start, h, g, from_word, n_words.
    Documents: id, h and g (hashes of id and text), s (source number), size, source_size, target, start; s and start
    name a row that has words.

    * Null texts and texts without a word have no place in a stream; a null source is the last source; rows
      alike in id and text take neighbouring places.  No rows give empty results.  Other columns are not read.
    * Only sizes by source reach the driver.  Blocks and slots meet by source and block number, so a source
      with a third of all words spreads over all tasks.
    """
    spark = docs.sparkSession
    placed = materialize(positions(docs, doc_id, source, text), "mix-places")
    sizes = [(r["src"], r["n"]) for r in placed.groupBy("src").agg(F.sum("size").alias("n")).collect()]
    sources, pieces = plan(spark, sizes, mix)
    known = placed.join(sources, F.col("src").eqNullSafe(F.col("name"))).select("id", "h", "g", "s", "size", "source_size", "target", "start")
    length, end = F.lit(mix.block).cast("long"), F.col("start") + F.col("size")
    held = known.where("size > 0").select("s", "start", "h", "g", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * length)
    # the plan of the slots looks small to the optimiser, but the slots grow with the words: never broadcast them
    spans = held.hint("merge").join(slot_table(pieces, mix), ["s", "block"])
    spans = spans.withColumn("n_words", F.least(F.col("end"), F.col("block") * length + F.col("taken")) - lo).where("n_words > 0")
    return spans.select("shard", "slot", "turn", "block", "s", "start", "h", "g", (lo - F.col("start")).alias("from_word"), "n_words"), known


def mix_documents(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row."""
    spans, known = mix_spans(docs, mix, doc_id, source, text)
    taken = spans.groupBy("s", "start").agg(F.sum("n_words").alias("n"))
    out = known.join(taken, ["s", "start"], "left")
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def _cut(column: pa.Array, spans: list[list[dict]]) -> list[str]:
    """The words of each text's spans: the text itself where they cover it, else the pieces line by line."""
    raw, at = utf8(column)
    starts, ends, doc = words(raw, at)
    base = np.searchsorted(doc, np.arange(len(at)))
    out = []
    for d, own in enumerate(spans):
        merged: list[list[int]] = []
        for x in sorted((x["from_word"], x["n_words"]) for x in own):
            if merged and merged[-1][1] == x[0]:
                merged[-1][1] += x[1]
            else:
                merged.append([x[0], x[0] + x[1]])
        if merged == [[0, int(base[d + 1] - base[d])]]:
            out.append(raw[at[d] : at[d + 1]].tobytes().decode())
        else:
            out.append("\n".join(raw[starts[base[d] + a] : ends[base[d] + b - 1]].tobytes().decode() for a, b in merged))
    return out


def mixed_texts(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The mix as documents: for each pass, what it takes of each row, with the row's other columns.

    A document whole in a pass keeps its text byte for byte; of a document cut by a block only the taken words
    stay.  Rows alike in id and text are told apart by their places only; the other columns of all of them are those
    of the one whose columns hash least.  Texts without a word are never taken; no rows give an empty result.
    ``n_chars`` names a column to hold the length of the new text.
    """
    spans, _ = mix_spans(docs, mix, doc_id, source, text)
    h, g, cut = fresh(docs, "h", "g", "spans")
    pieces = spans.groupBy("h", "g", "s", "start", "turn").agg(F.collect_list(F.struct("from_word", "n_words")).alias(cut)).select(F.col("h").alias(h), F.col("g").alias(g), cut)
    schema, names = docs.schema, list(docs.columns)
    own_h, own_g = row_key(doc_id, text)
    once = one_of_alike(docs.withColumns({h: own_h, g: own_g}), [h, g])
    joined = once.join(pieces, [h, g]).select(*(F.col(f"`{c}`") for c in names), cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                got = _cut(piece.column(text), piece.column(cut).to_pylist())
                made = {text: pa.array(got, pa.string())}
                if n_chars:
                    made[n_chars] = pa.array([len(x) for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([made.get(c, piece.column(c)) for c in names], names)

    return map_texts(joined, run, schema)
