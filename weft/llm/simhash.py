"""SimHash near-duplicate groups: fingerprints, BK-trees over shards of fingerprints, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import _SPACE, counted, discard, fresh, join_heavy, map_texts, materialize, one_of_alike, row_key, slices, utf8, words

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans at once.  Spans are ordered by length, so those with a next lane are a prefix."""
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    half = np.ndarray((len(raw) - 7,), "<u4", raw.data, strides=(1,))
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left = starts[order].copy(), length[order].copy()
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        h = np.full(len(at), seed + _P5, np.uint64)
        n = int(np.searchsorted(-left, -32, side="right"))
        if n:
            acc = [np.full(n, seed + _P1 + _P2), np.full(n, seed + _P2), np.full(n, seed), np.full(n, seed - _P1)]
            m = n
            while m:
                for k in range(4):
                    acc[k][:m] = _round(acc[k][:m], wide[at[:m] + 8 * k])
                at[:m] += 32
                left[:m] -= 32
                # by whole stripes left the order by length still holds
                m = int(np.searchsorted(-left[:m], -32, side="right"))
            long = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for k in range(4):
                long = (long ^ _round(np.uint64(0), acc[k])) * _P1 + _P4
            h[:n] = long
        h += length[order].astype(np.uint64)
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            if not len(some):
                break
            h[some] = _rotl(h[some] ^ _round(np.uint64(0), wide[at[some]]), 27) * _P1 + _P4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        h[some] = _rotl(h[some] ^ (half[at[some]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[some] += 4
        left[some] -= 4
        for _ in range(3):
            some = np.flatnonzero(left > 0)
            h[some] = _rotl(h[some] ^ (raw[at[some]].astype(np.uint64) * _P5), 11) * _P1
            at[some] += 1
            left[some] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


def _majority(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document, the bits set in over half of its hashes; ``doc`` is sorted."""
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    cut = np.flatnonzero(nth % 255 == 0)  # byte-wide counters hold 255 at most
    owner = doc[cut]
    run = np.flatnonzero(np.diff(owner, prepend=-1))
    total = np.diff(np.append(first, len(h)))
    own = owner[run]
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), cut)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), run, axis=0)
        set_ = (2 * counts > total[:, None]).astype(np.uint64)
        for b in range(8):
            out[own] |= set_[:, b] << np.uint64(8 * b + k)
    return out


def fingerprints(column: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of the ``size``-word shingles of each text, A-Z lower-cased, repeats included."""
    raw, at = utf8(column)
    n = len(at) - 1
    starts, ends, doc = words(raw, at)
    if not len(starts):
        return np.zeros(n, np.uint64)
    low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    low[space] = 32
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    low, starts, ends = low[keep], place[starts], place[ends]
    count = np.bincount(doc, minlength=n)
    base = np.cumsum(count) - count
    nth = np.arange(len(doc)) - base[doc]
    short = count < size
    head = np.flatnonzero(np.where(short[doc], nth == 0, nth <= count[doc] - size))
    last = head + np.where(short[doc[head]], count[doc[head]], size) - 1
    return _majority(xxh64(low, starts[head], ends[last], seed), doc[head], n)


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3, name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint of each whole text as a signed long."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + f", `{name}` long"

    def run(batches):
        for piece in slices(batches, "__text"):
            got = fingerprints(piece.column("__text"), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(got, pa.int64())], [*keep, name])

    return map_texts(docs.select(*keep, F.col(text).alias("__text")), run, schema)


class BKTree:
    """Burkhard-Keller tree over 64-bit fingerprints: each child hangs on the edge of its Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Positions of the values within ``radius``; only edges d - radius to d + radius are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.edges[at]
            if edges:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def add(self, value: int) -> int:
        own = len(self.values)
        at = 0 if own else -1
        while at >= 0:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.edges[at]:
                self.edges[at][d] = own
                break
            at = self.edges[at][d]
        self.values.append(value)
        self.edges.append({})
        return own


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one shard, found with its tree."""
    tree, root, out = BKTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.search(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((value, values[j]))
        tree.add(value)
    return out


def _split(bits: list[int], parts: int) -> list[list[int]]:
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut[:-1], cut[1:])]


def block_masks(radius: int, levels: int) -> list[list[int]]:
    """Masks of agreeing bits by level: level 0 splits 64 bits into radius + 1 blocks, each next level what is left."""
    parts, out, used = radius + 1, [], [[]]
    for _ in range(levels):
        used = [u + b for u in used for b in _split([x for x in range(64) if x not in set(u)], parts)]
        out.append([sum(1 << x for x in u) for u in used])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch | None:
            found = shard_links([v & 0xFFFFFFFFFFFFFFFF for v in held], radius) if len(held) > 1 else []
            return [(_signed(a), _signed(b)) for a, b in found]

        for batch in batches:
            out: list[tuple[int, int]] = []
            p, v, fp = (np.asarray(batch.column(c)) for c in ("p", "v", "fp"))
            cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(v) != 0)) + 1
            lone = np.diff(np.concatenate([[0], cut, [len(fp)]])) == 1
            for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(fp)])):
                if b > a:
                    own = (p[a], v[a])
                    if own != key:
                        if len(held) > 1:
                            out += links()
                        key, held = own, []
                        if lone[i] and 0 < i < len(lone) - 1:
                            continue
                    held += fp[a:b].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = links()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


#: Fingerprints of a shard; larger shards are split by more of their bits.
SHARD = 2048
LEVELS = 4


def near_links(nodes: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits as the full link set does.

    Two fingerprints within the radius agree in one of radius + 1 blocks of bits, so every block's value
    makes a shard with a BK-tree of its own, and each fingerprint is searched in its shards' trees.  A shard
    over ``shard`` fingerprints is split again by the blocks of its other bits, which loses no link for the
    same reason.  After four levels the bits left bound a shard (13 bits for radius 2: 8192 fingerprints),
    however many rows share a block.  Trees are built where their shard lies: no fingerprint table goes to
    the driver or to every executor.
    """
    masks = block_masks(radius, LEVELS)
    parts = radius + 1
    keyed = nodes.select("fp", F.lit(0).alias("q"))
    found = None
    for level in range(LEVELS):
        lookup = F.array(*(F.lit(_signed(m)) for m in masks[level]))
        keyed = keyed.select("fp", F.explode(F.sequence(F.col("q") * parts, F.col("q") * parts + parts - 1)).alias("p"))
        keyed = keyed.withColumn("v", F.col("fp").bitwiseAND(F.element_at(lookup, F.col("p") + 1)))
        hot = None
        if level < LEVELS - 1:
            hot = materialize(keyed.groupBy("p", "v").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("p", "v"), "hot")
            hot = hot if hot.take(1) else None
        cold = keyed.join(hot, ["p", "v"], "left_anti") if hot is not None else keyed
        links = cold.repartition("p", "v").sortWithinPartitions("p", "v", "fp").mapInArrow(_tree_links(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if hot is None:
            break
        keyed = keyed.join(hot, ["p", "v"], "left_semi").select("fp", F.col("p").alias("q"))
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, the root being the smallest node reachable: alternating large and small stars.

    Rounds go on until the edges no longer change, however many that takes; each is written, with its number of edges
    and two sums that tell a change, and the one before is deleted.
    """
    marks = [F.sum(F.xxhash64("u", "v") % 1000003).alias("a"), F.sum(F.xxhash64("v", "u") % 998244353).alias("b")]
    edges, seen = counted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", *marks)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k"))
        large = join_heavy(both, low, "u", 2 * seen["n"], "k").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = join_heavy(large, low, "u", 2 * seen["n"], "k").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        later, now = counted(small, "edges", *marks)
        discard(edges)
        edges = later
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_members(docs: DataFrame, radius: int, size: int, doc_id: str, text: str, shared: tuple[int, tuple[int, int]] | None = None) -> DataFrame:
    """id, h and g (hashes of id and text), fp, root (the least fingerprint of its group) and component_id of every row."""
    h, g = row_key(doc_id, text)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), h.alias("h"), g.alias("g"), F.xxhash64(text).alias("x"))
    own = ["id", "h", "g", "x"]
    rows = with_fingerprint(rows, own, "t", size) if shared is None else overlap.described(rows, own, shared[0], lambda column: fingerprints(column, size))
    rows, seen = counted(rows, "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("k")), "nodes")
    stars = components(near_links(nodes, radius))
    if shared is not None:
        stars = overlap.join_components(docs, text, rows, stars, components, lambda column: fingerprints(column, size), *shared)
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "rep", "k", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("kk"))
    named = join_heavy(rooted, least, "root", seen["n"], "kk")
    return join_heavy(rows.select("id", "h", "g", "fp"), named, "fp", seen["n"], "k")


def near_groups(docs: DataFrame, radius: int = 2, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id linked directly or through others.

    * Null and empty texts and texts without a word have fingerprint zero and link as any other; texts under
      ``size`` words hash as one shingle.  Equal fingerprints are one node, so copies in any number make no pairs.
    * Rows with a null doc_id get a component as all do; component_id is null only where no doc_id is known in it.
      Repeated rows stay, each with its group.  No rows give an empty result.  Other columns are not read.
    """
    rows = near_members(docs, radius, size, doc_id, text)
    return rows.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, size: int = 3, doc_id: str = "doc_id", text: str = "text", shared: tuple[int, tuple[int, int]] | None = None) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, null last, then the smallest hash of id and text.

    ``shared``, as (5, (4, 5)), also groups all texts whose sets of five-word shingles have a Jaccard similarity
    of 4/5 or more.  Only ids, hashes, fingerprints and shingles are grouped; the texts move once, by 128 bits of
    doc_id and text, to meet them.

    * Null, empty and wordless texts share fingerprint zero and so one row of them stays; of rows alike in id and text
      the one whose other columns hash least stays.  No rows give an empty result.  All columns come out as they are.
    """
    rows = near_members(docs, radius, size, doc_id, text, shared)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h", "g")).alias("k")).select("k.h", "k.g")
    h, g = fresh(docs, "h", "g")
    first = materialize(first.withColumnsRenamed({"h": h, "g": g}), "first")
    own_h, own_g = row_key(doc_id, text)
    once = docs.withColumns({h: own_h, g: own_g}).join(first, [h, g], "left_semi")
    return one_of_alike(once, [h, g]).select(*(f"`{c}`" for c in docs.columns))
