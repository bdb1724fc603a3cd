"""SentencePiece encoding and decoding with numpy over batches of words.

Text is cut where no piece of the vocabulary can reach across; the distinct words of a batch advance together with
those of the same length.  For unigram models the words go through Viterbi: hashes of substrings probe
the sorted hashes of the pieces and the maxima keep backpointers.  A BPE model's scores are merge ranks, which no
sum over pieces reproduces, so its words are merged instead, best-ranked neighbours first, in the same batches
and with the same probing of sorted keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import map_texts, powers, slices

SPACE = "▁"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_A_INV, _B_INV = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_A, _B))
_SMALL = 0x250
#: Words longer than this are merged one by one with a heap.
LONG = 48
#: Words a worker remembers.
CACHE = 60_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hash:
    def __init__(self, values: np.ndarray, base: np.uint64, inverse: np.uint64):
        self.inverse = powers(inverse, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """A vocabulary ready for batches: character ids, joinable neighbours, sorted keys of pieces and of merges."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is can decode to it")
        self.prefix, self.unigram, self.unk = spec.add_dummy_prefix, m.trainer_spec.model_type == 1, 0
        self.pieces = [p.piece for p in m.pieces]
        self.score = np.array([p.score for p in m.pieces], np.float64)
        self.bytes = np.full(256, -1, np.int32)
        words: dict[str, int] = {}
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type in (1, 4):
                words[p.piece] = i
            elif p.type == 2:
                self.unk = i
        self.words, self.longest = words, max(map(len, words), default=1)
        self.fallback = bool((self.bytes >= 0).all())
        self.unk_score = (min((self.score[i] for i in words.values()), default=0.0)) - 10.0
        # characters
        self.char_of = np.full(0x110000, -1, np.int32)
        for w, i in words.items():
            if len(w) == 1:
                self.char_of[ord(w)] = i
        # neighbours that some piece holds
        pairs = {(ord(a), ord(b)) for w in words for a, b in zip(w, w[1:])}
        self.near = np.zeros((_SMALL + 1, _SMALL + 1), bool)
        small = lambda c: c if c < _SMALL - 1 else _SMALL - 1 if c == ord(SPACE) else None
        for a, b in pairs:
            if small(a) is not None and small(b) is not None:
                self.near[small(a), small(b)] = True
        self.far = np.unique(np.array([a << 21 | b for a, b in pairs] or [0], np.uint64))
        # sorted piece keys
        flat = [(self.key(w), i) for w, i in words.items()]
        order = np.argsort(np.array([k for k, _ in flat], np.uint64))
        self.keys = np.array([k for k, _ in flat], np.uint64)[order]
        self.key_id = np.array([i for _, i in flat], np.int32)[order]
        # sorted merge keys
        merges = [(words[w[:k]] << 32 | words[w[k:]], i) for w, i in words.items() for k in range(1, len(w)) if w[:k] in words and w[k:] in words] if not self.unigram else []
        merges.sort()
        self.merge_keys = np.array([k for k, _ in merges] or [-1], np.int64)
        self.merge_id = np.array([i for _, i in merges] or [-1], np.int32)
        self.merge = dict(merges)
        # decoding
        parts = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.out_at = np.cumsum([0, *map(len, parts)])
        self.out = np.frombuffer(b"".join(parts), np.uint8)
        self.cache: dict[int, tuple[int, np.ndarray]] = {}

    @staticmethod
    def key(word: str) -> int:
        v = _mix(codes(word).astype(np.uint64))
        return int((v * powers(_A, len(v))).sum(dtype=np.uint64))

    def cuts(self, cps: np.ndarray) -> np.ndarray:
        """Marks the positions (from 1) that no piece spans with the position before."""
        c = np.minimum(cps, _SMALL).astype(np.int32)
        c[cps == ord(SPACE)] = _SMALL - 1
        c[cps == _SMALL - 1] = _SMALL
        joined = self.near[c[:-1], c[1:]]
        rare = np.flatnonzero((c[:-1] == _SMALL) | (c[1:] == _SMALL))
        if len(rare):
            pair = cps[rare].astype(np.uint64) << np.uint64(21) | cps[rare + 1].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.far, pair), len(self.far) - 1)
            joined[rare] = self.far[at] == pair
        return ~joined

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.key_id[at], -1)

    def viterbi(self, cps: np.ndarray) -> list[np.ndarray]:
        """Best segmentations of words of one length (rows of ``cps``) under a unigram model; -1 - c is character c unknown."""
        n, length = cps.shape
        values = _mix(cps.astype(np.uint64)) * powers(_A, length)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum(values, axis=1, dtype=np.uint64, out=sums[:, 1:])
        inverse = powers(_A_INV, length + 1)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, used = np.zeros((n, length + 1), np.int32), np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.find((sums[:, end] - sums[:, start]) * inverse[start])
                score = np.where(piece >= 0, best[:, start] + self.score[piece], -np.inf)
                if end - start == 1:
                    unknown = piece < 0
                    score[unknown] = best[unknown, start] + self.unk_score
                    piece = np.where(unknown, -1 - cps[:, start].astype(np.int64), piece)
                better = score > best[:, end]
                best[better, end], back[better, end], used[better, end] = score[better], start, piece[better]
        at, rows = np.full(n, length), np.arange(n)
        steps = []
        while (at > 0).any():
            steps.append(np.where(at > 0, used[rows, at], np.iinfo(np.int64).min))
            at = np.where(at > 0, back[rows, at], 0)
        grid = np.array(steps[::-1]).T
        return [r[r != np.iinfo(np.int64).min] for r in grid]

    def merged(self, cps: np.ndarray) -> list[np.ndarray]:
        """Pieces of words of one length under a BPE model: the best-ranked neighbours merge first, the left of equals."""
        n, length = cps.shape
        ids = self.char_of[cps].astype(np.int64)
        ids = np.where(ids < 0, -1 - cps.astype(np.int64), ids)
        size = np.full(n, length)
        live = np.arange(n)
        score = np.append(self.score, -np.inf)
        while len(live) and ids.shape[1] > 1:
            own = ids[live]
            left, right = own[:, :-1], own[:, 1:]
            key = np.where((left >= 0) & (right >= 0) & (np.arange(1, own.shape[1]) < size[live, None]), left << 32 | right, -2)
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            made = np.where(self.merge_keys[at] == key, self.merge_id[at], -1)
            rank = score[made]
            col = np.argmax(rank, axis=1)
            some = rank[np.arange(len(live)), col] > -np.inf
            live, own, col, made = live[some], own[some], col[some], made[some]
            if not len(live):
                break
            own[np.arange(len(live)), col] = made[np.arange(len(live)), col]
            take = np.arange(own.shape[1] - 1)[None, :]
            take = take + (take > col[:, None])
            ids[live, :-1] = np.take_along_axis(own, take, axis=1)
            size[live] -= 1
        return [ids[i, : size[i]] for i in range(n)]

    def merged_long(self, cps: np.ndarray) -> np.ndarray:
        """One long word under a BPE model, by a heap over the neighbours."""
        ids = [int(self.char_of[c]) if self.char_of[c] >= 0 else -1 - int(c) for c in cps.tolist()]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and ids[i] >= 0 and ids[j] >= 0 and (made := self.merge.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (-self.score[made], i, made, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        gone = [False] * len(ids)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = made, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x, g in zip(ids, gone) if not g], np.int64)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Unknown characters as their bytes, or as the unknown piece where the model has no bytes."""
        if (ids >= 0).all():
            return ids.astype(np.int32)
        out: list[int] = []
        for x in ids.tolist():
            if x >= 0:
                out.append(x)
            elif self.fallback:
                out += self.bytes[list(chr(-1 - x).encode("utf-8", "surrogatepass"))].tolist()
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return np.array(out, np.int32)

    def segment(self, cps: np.ndarray, starts: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Pieces of words given by start and length; words of a length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
        order = np.argsort(length, kind="stable")
        cut = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, cut):
            n = int(length[own[0]]) if len(own) else 0
            if n > LONG and not self.unigram:
                for i in own.tolist():
                    out[i] = self.spelled(self.merged_long(cps[starts[i] : starts[i] + n]))
                continue
            for part in range(0, len(own), 20_000):
                some = own[part : part + 20_000]
                grid = cps[starts[some][:, None] + np.arange(n)]
                got = self.viterbi(grid) if self.unigram else self.merged(grid)
                ends = np.cumsum([len(x) for x in got])
                starts_ = np.concatenate([[0], ends[:-1]])
                flat = np.concatenate(got)
                odd, small = np.add.reduceat(flat < 0, starts_) > 0, flat.astype(np.int32)
                for i, ids, a, b, unknown in zip(some.tolist(), got, starts_.tolist(), ends.tolist(), odd.tolist()):
                    out[i] = self.spelled(ids) if unknown else small[a:b]
        return out

    def parts(self, body: str, most: int) -> list[str]:
        """A text in parts of about ``most`` characters, cut where no piece can reach across."""
        out, at = [], 0
        while len(body) - at > most:
            window, cut = 4096, None
            while cut is None and at + most + window // 2 < len(body):
                found = np.flatnonzero(self.cuts(codes(body[at + most : at + most + window])))
                cut, window = (at + most + int(found[0]) + 1 if len(found) else None), window * 4
            if cut is None:
                break
            out.append(body[at:cut])
            at = cut
        return [*out, body[at:]]

    def encode(self, texts: list[str | None], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and how many each text has; long texts go part by part."""
        lead = SPACE if self.prefix else ""
        bodies = [lead + t.replace(" ", SPACE) if t else "" for t in texts]
        if max(map(len, bodies), default=0) <= most:
            return self._encode(bodies)
        ids, count = [], []
        for body in bodies:
            own = [self._encode([part])[0] for part in self.parts(body, most)]
            ids += own
            count.append(sum(map(len, own)))
        return np.concatenate(ids), np.array(count, np.int64)

    def _encode(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(b) for b in bodies], np.int64)
        cps = codes("".join(bodies))
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(bodies), np.int64)
        first = np.ones(len(cps), bool)
        first[1:] = self.cuts(cps)
        begins = np.cumsum(size) - size
        first[begins[size > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(cps))
        values = _mix(cps.astype(np.uint64))
        h, g = _Hash(values, _A, _A_INV).of(starts, ends), _Hash(values, _B, _B_INV).of(starts, ends)
        _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (g != g[pick][inverse]).any():  # two words with one hash: tell them apart by both
            _, pick, inverse = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
        if len(self.cache) > CACHE:
            self.cache.clear()
        ids: list[np.ndarray | None] = []
        for a, b in zip(h[pick].tolist(), g[pick].tolist()):
            held = self.cache.get(a)
            ids.append(held[1] if held is not None and held[0] == b else None)
        new = np.array([i for i, x in enumerate(ids) if x is None], np.int64)
        if len(new):
            at = pick[new]
            for i, k, got in zip(new.tolist(), at.tolist(), self.segment(cps, starts[at], (ends - starts)[at])):
                ids[i] = got
                if ends[k] - starts[k] <= LONG:
                    self.cache[int(h[k])] = (int(g[k]), got)
        count = np.array([len(x) for x in ids], np.int64)
        flat, base = np.concatenate(ids), np.cumsum(count) - count
        n = count[inverse]
        total = np.cumsum(n)
        out = flat[np.repeat(base[inverse] - (total - n), n) + np.arange(int(total[-1]))]
        owner = np.searchsorted(np.cumsum(size), starts, side="right")
        return out, np.bincount(owner, weights=n, minlength=len(bodies)).astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts end to end and their offsets."""
        n = (self.out_at[1:] - self.out_at[:-1])[ids]
        total = np.cumsum(n) if len(n) else np.zeros(0, np.int64)
        keep = np.ones(int(total[-1]) if len(n) else 0, bool)
        parts = []
        for i in range(0, len(ids), 1 << 18):
            own, m = ids[i : i + (1 << 18)], n[i : i + (1 << 18)]
            end = np.cumsum(m)
            parts.append(self.out[np.repeat(self.out_at[own] - (end - m), m) + np.arange(int(end[-1]))])
        raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        ends = np.concatenate([[0], total])[np.cumsum(count)] if len(count) else np.zeros(0, np.int64)
        at = np.concatenate([[0], ends]).astype(np.int64)
        if self.prefix:
            heads = at[:-1][np.diff(at) > 0]
            heads = heads[raw[heads] == 0x20]
            keep[heads] = False
            shift = np.concatenate([[0], np.cumsum(~keep)])
            raw, at = raw[keep], at - shift[at]
        return raw, at


_MODELS: dict[int, Model] = {}


def model(data: bytes) -> Model:
    if (held := _MODELS.get(hash(data))) is None:
        held = _MODELS[hash(data)] = Model(data)
    return held


def encode_texts(docs: DataFrame, model_file: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_pieces, and round_trip: the ids decode to the text byte for byte.

    * A null or empty text has no pieces and round_trip is true for the empty one, null for null.  A text that
      holds U+2581 decodes with spaces in its place, so its round_trip is false.
    * Repeated rows and a null doc_id stay as they are.  No rows give an empty result.  Other columns are not read.
    * Row by row: no shuffle, one piece of about 1 MB of text (or a part of a longer one) in memory.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocab.read(model_file, "piece_bpe_32k.model"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data.value)
        for piece in slices(batches, "t"):
            texts = piece.column("t").to_pylist()
            ids, count = m.encode(texts)
            raw, at = m.decode(ids, count)
            same = [None if t is None else raw[a:b].tobytes() == t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist())]
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(count, pa.int64()), pa.array(same, pa.bool_())], [doc_id, "ids", "n_pieces", "round_trip"])

        m.cache = {}

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return map_texts(rows, run, f"`{doc_id}` {kind}, ids array<int>, n_pieces long, round_trip boolean")


def decode_ids(rows: DataFrame, model_file: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``text``, decoded from an array of piece ids; null for null."""
    data = rows.sparkSession.sparkContext.broadcast(vocab.read(model_file, "piece_bpe_32k.model"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(data.value)
        for batch in batches:
            col = batch.column("__ids")
            count = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0), dtype=np.int64)
            raw, at = m.decode(np.asarray(col.flatten(), dtype=np.int64), count)
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), col.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return map_texts(rows.select(*keep, F.col(ids).alias("__ids")), run, schema)
