"""Links between texts whose sets of word shingles overlap: MinHash bands find candidates, the exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SpanHashes, counted, discard, map_texts, materialize, slices, utf8, words

_MIX = np.uint64(0x9FB21C651E98DF25)
#: Bands and rows of the signature: at a similarity of 0.8 a pair shares no band with probability 0.002, at 0.9 with 1e-6.
BANDS, ROWS = 16, 5
_DRAWN = np.random.default_rng(64).integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of every ``size``-word shingle, A-Z lower-cased; a shorter text is one shingle."""
    raw, at = utf8(column)
    starts, ends, doc = words(raw, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    word = SpanHashes(low).of(starts, ends)
    count = np.bincount(doc, minlength=len(at) - 1)
    nth = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    most = np.minimum(count, size)[doc]
    head = np.flatnonzero(nth <= count[doc] - most)
    out = np.zeros(len(head), np.uint64)
    for k in range(size):
        has = k < most[head]
        out[has] = (out[has] ^ (out[has] >> np.uint64(31))) * _MIX + word[head[has] + k] + np.uint64(1)
    return (out ^ (out >> np.uint64(32))) * _MIX, doc[head]


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text and their document index."""
    h, doc = shingles(column, size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def bands(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Band keys of each text (rows), from the least of its shingles under each of BANDS x ROWS hash functions; none for no shingles."""
    some = np.flatnonzero(n)
    out = np.zeros((len(n), BANDS), np.uint64)
    if not len(some):
        return out
    low = (key ^ (key >> np.uint64(32))).astype(np.uint32)
    first = (np.cumsum(n) - n)[some]
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            own = np.full(len(some), band + 1, np.uint64)
            for row in range(band * ROWS, band * ROWS + ROWS):
                mixed = low * _DRAWN[0, row]
                mixed ^= mixed >> np.uint32(15)
                mixed *= _DRAWN[1, row]
                least = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(13)), first)
                own = (own ^ (own >> np.uint64(31))) * _MIX + least
            out[some, band] = own ^ (own >> np.uint64(29))
    return out


def parity(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text a bit string of twice its shingles or more, as words and their offsets: a bit is how often it was hit, modulo 2.

    The bits in which two such strings differ are at most the shingles that one of the sets has and the other
    has not.  Lengths are powers of two, so a longer string folds to a shorter one's length by xor of its halves.
    """
    size = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(1, n / 32))).astype(np.int64), 0)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint64)
    bit = (key & (64 * size[doc] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, at[doc] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out, at


def described(rows: DataFrame, keep: list[str], size: int, fingerprints: Callable, text: str = "t") -> DataFrame:
    """The columns ``keep``, fingerprint fp, number of distinct shingles n, their parity bits and band keys of each whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", fp long, n int, bits array<long>, bands array<long>"

    def run(batches):
        for piece in slices(batches, text):
            fp = fingerprints(piece.column(text)).view(np.int64)
            key, doc = shingle_sets(piece.column(text), size)
            n = np.bincount(doc, minlength=piece.num_rows)
            words, at = parity(key, doc, n)
            bits = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands(key, n).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(fp), pa.array(n.astype(np.int32)), bits, own], [*keep, "fp", "n", "bits", "bands"])

    return map_texts(rows.select(*keep, text), run, schema)


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.xxhash64(text).alias("x"), F.col(text).alias("t"))


def _sets(texts: DataFrame, size: int, fingerprints: Callable) -> DataFrame:
    """x, fp, s: hash, fingerprint and shingle set of each text."""

    def run(batches):
        for piece in slices(batches, "t"):
            key, doc = shingle_sets(piece.column("t"), size)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=piece.num_rows))]).astype(np.int32)
            fp = pa.array(fingerprints(piece.column("t")).view(np.int64))
            yield pa.RecordBatch.from_arrays([piece.column("x"), fp, pa.ListArray.from_arrays(pa.array(at), pa.array(key.view(np.int64)))], ["x", "fp", "s"])

    return map_texts(texts, run, "x long, fp long, s array<long>")


def _rooted(known: DataFrame, stars: DataFrame) -> DataFrame:
    return known.join(stars, F.col("fp") == F.col("node"), "left").select("x", "fp", F.coalesce("root", "fp").alias("root"), "bands")


def _candidates(known: DataFrame, stars: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of texts of a shared band that are not in one group yet: each text with one of its band, and with its
    neighbour in the order of the band that follows.

    A band of m texts gives at most 2 m pairs, however many of them are alike; another text leads in each round.
    """
    rooted = _rooted(known, stars)
    post = rooted.select("x", "fp", "root", "bands", F.posexplode("bands").alias("band", "key"))
    post = post.select("key", "x", "fp", "root", F.xxhash64(F.element_at("bands", (F.col("band") + 1 + step) % BANDS + 1), F.lit(step)).alias("o"))
    w, text_of = W.partitionBy("key"), F.struct("x", "fp", "root")
    first = F.min(F.struct(F.xxhash64("x", F.lit(step)).alias("o"), text_of.alias("t"))).over(w)["t"]
    near = post.select(text_of.alias("p"), F.min("root").over(w).alias("lo"), F.max("root").over(w).alias("hi"), first.alias("m"), F.lag(text_of).over(w.orderBy("o", "x")).alias("l")).where("lo <> hi")
    pairs = near.select("p", F.explode(F.array("m", "l")).alias("q")).where("q is not null and p.root <> q.root")
    end = lambda e: F.struct(f"{e}.x", f"{e}.fp")
    return pairs.select(F.least(end("p"), end("q")).alias("a"), F.greatest(end("p"), end("q")).alias("b")).distinct()


def _maybe(pairs: DataFrame, known: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that may be as similar as asked, by the sizes of their sets and the bits in which these differ.

    Nothing similar is lost: sets of similarity t differ in at most (1 - t) / (1 + t) of the sum of their sizes,
    and the parity bits of two sets in no more than the sets do.
    """
    num, den = least
    side = lambda e: known.select(F.struct("x", "fp").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"v{e}"))
    both = pairs.join(side("a"), "a").where("na > 0").join(side("b"), "b").where(_sizes(num, den))
    return both.where(_near(num, den)).select("a", "b")


def _sizes(num: int, den: int) -> Column:
    """Sets of na and nb shingles may be as similar as asked."""
    return (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)


def _near(num: int, den: int) -> Column:
    """So may sets of parity bits va and vb."""
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2 + 1).cast("int"), (F.size(v) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    fold = lambda v, o: F.when(F.size(v) > F.size(o), half(v)).otherwise(v)
    apart = F.aggregate(F.zip_with(fold(F.col("va"), F.col("vb")), fold(F.col("vb"), F.col("va")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)


#: Texts of a band that one task compares with as many others; larger bands are dealt out by pairs of such blocks.
BLOCK = 1024


def _rest(known: DataFrame, stars: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs and the tables that they are read from: all pairs (a, b) that share a band, are not in one group yet and may be as similar as asked: what the rounds left over.

    Bands whose texts are one group make no pairs.  A pair is made in the first band that it shares, and sizes and
    parity bits decide where it is made, so only those that may be similar leave the join.
    """
    post = _rooted(known, stars).select("x", "fp", "root", F.posexplode("bands").alias("band", "key"))
    open_ = materialize(post.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("lo <> hi").select("key", "nb"), "open")
    block = F.pmod(F.xxhash64("x", "fp", F.lit(7)), F.col("nb")).cast("int")
    own = post.join(open_, "key").select("x", "fp", "root", "band", "key", "nb", block.alias("block"))
    own = materialize(own.join(known, ["x", "fp"]).select(own["*"], "n", "bits", "bands"), "rest")
    side = lambda e, other: own.select("key", F.struct("x", "fp").alias(e), F.col("root").alias(f"r{e}"), "band", F.col("n").alias(f"n{e}"), F.col("bits").alias(f"v{e}"), F.col("bands").alias(f"k{e}"), "block", F.explode(other).alias("other"))
    p = side("a", F.sequence("block", F.col("nb") - 1)).withColumnsRenamed({"block": "lo", "other": "hi"})
    q = side("b", F.sequence(F.lit(0), "block")).withColumnsRenamed({"block": "hi", "other": "lo", "key": "key_b", "band": "band_b"}).withColumnsRenamed({"lo": "lo_b", "hi": "hi_b"})
    met = (F.col("key") == F.col("key_b")) & (F.col("lo") == F.col("lo_b")) & (F.col("hi") == F.col("hi_b"))
    met &= ((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b"))) & (F.col("ra") != F.col("rb")) & _sizes(*least)
    met &= F.array_position(F.zip_with("ka", "kb", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
    return p.join(q, met & _near(*least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), [open_, own]


#: Texts to compare up to this number (8 MB of hashes) are broadcast to find their texts; more meet them by a shuffle.
BROADCAST_TEXTS = 1_000_000


def _verified(texts: DataFrame, pairs: DataFrame, size: int, least: tuple[int, int], fingerprints: Callable) -> DataFrame:
    """The fingerprints (u, v) of the pairs of texts that are as similar as asked: exact, over the whole sets."""
    num, den = least
    wanted, seen = counted(pairs.select(F.explode(F.array("a.x", "b.x")).alias("x")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if seen["n"] <= BROADCAST_TEXTS else wanted
    sets = materialize(_sets(texts.join(wanted, "x", "left_semi"), size, fingerprints).dropDuplicates(["x", "fp"]), "sets")
    side = lambda e: sets.select(F.col("x").alias(f"{e}x"), F.col("fp").alias(f"{e}fp"), F.col("s").alias(f"s{e}"))
    both = pairs.select(F.col("a.x").alias("ax"), F.col("a.fp").alias("afp"), F.col("b.x").alias("bx"), F.col("b.fp").alias("bfp"))
    both = both.join(side("a"), ["ax", "afp"]).join(side("b"), ["bx", "bfp"])
    found = materialize(both.where(F.size(F.array_intersect("sa", "sb")) * (num + den) >= (F.size("sa") + F.size("sb")) * num).select(F.col("afp").alias("u"), F.col("bfp").alias("v")), "found")
    discard(sets)
    return found


#: Rounds of candidates by leaders and neighbours; a round that finds no new pair is the last.  The rest is compared after them.
ROUNDS = 3


def join_components(docs: DataFrame, text: str, rows: DataFrame, stars: DataFrame, components: Callable, fingerprints: Callable, size: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """(node, root) as ``stars``, with the fingerprints of texts joined whose Jaccard similarity is ``least`` or more.

    ``rows`` is what ``described`` makes with a hash x of the text; a text is known by x and fp.  Candidates share a
    MinHash band; every link is a pair whose whole sets were compared.  The rounds join most texts by pairs in
    proportion to their number; then every pair that shares a band and is in two groups still is compared.
    """
    texts = _hashed(docs, text)
    known = materialize(rows.where("n > 0").select("x", "fp", "n", "bits", "bands").dropDuplicates(["x", "fp"]), "texts")
    tested, held = None, []
    for step in range(ROUNDS):
        pairs = _candidates(known.select("x", "fp", "bands"), stars, step)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, seen = counted(pairs, "pairs")
        held.append(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not seen["n"]:
            break
        maybe, seen = counted(_maybe(pairs, known, least), "maybe")
        if seen["n"]:
            found = _verified(texts, maybe, size, least, fingerprints)
            stars = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found.select(F.col("u").alias("a"), F.col("v").alias("b"))))
            discard(found)
        discard(maybe)
    rest, read = _rest(known, stars, least)
    rest, seen = counted(rest if tested is None else rest.join(tested, ["a", "b"], "left_anti"), "left")
    if seen["n"]:
        found = _verified(texts, rest, size, least, fingerprints)
        stars = components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        discard(found)
    for table in (*held, *read, rest, known):
        discard(table)
    return stars
