"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks, trained on labelled sentences.

The kernel compares two words by their common subsequences of four symbols inside six, word edges being symbols
and each symbol skipped costing a factor, so an insult with a letter added or left out stays close to
itself; punctuation inside a word is dropped and letters spaced out are joined first.  A decision function over
landmarks, f(x) = sum of beta_l K(x, z_l), is linear in the subsequences: after training it collapses into one
table with a weight for each, and a word is scored by ten table lookups for each of its letters.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, release, slices

ORDER, SPAN, DECAY, SYMBOLS = 4, 6, 0.6, 32
OFFSETS = list(itertools.combinations(range(1, SPAN), ORDER - 1))
_GONE = 255


def _symbols() -> np.ndarray:
    """Symbol of each character: 0 white space, 1 to 31 letters by kind, 255 what is skipped (digits, punctuation)."""
    groups = {27: "éèêëēę", 28: "äàáâãåæāą", 29: "öòóôõøœ", 30: "üùúûūíìîïī", 31: "ñçßýÿżźśłćń"}
    by = {c: k for k, cs in groups.items() for c in cs}
    out = np.full(0x110000, _GONE, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        if c.isspace():
            out[cp] = 0
        elif c.isalpha():
            low = c.lower()[0]
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else by.get(low, 1 + ord(low) % 31)
    out[0x3040:0xD800] = 1 + np.arange(0x3040, 0xD800) % 31
    return out


_TABLE: list[np.ndarray] = []


@dataclass
class Words:
    """All words of some texts as one stream of symbols: word k is the edge at ``at[k]`` and the letters up to the next edge."""

    sym: np.ndarray
    at: np.ndarray
    doc: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.at, len(self.sym) - 1)) - 1


def word_stream(texts: list[str | None]) -> Words:
    """Case and punctuation are dropped, and of three or more letters spaced out the edges between them."""
    if not _TABLE:
        _TABLE.append(_symbols())
    bodies = [f" {t}\n" if t else "\n" for t in texts]
    cps = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _TABLE[0][cps]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(b) for b in bodies])
    keep = sym != _GONE
    sym, doc = sym[keep], doc[keep]
    edge = sym == 0
    drop = edge.copy()
    drop[-1:] = False
    drop[:-1] &= edge[1:]  # of a run of edges the last one stays
    # an edge between two words of one letter, when a third follows or precedes
    one = np.zeros(len(sym), bool)
    if len(sym) > 6:
        one[1:-1] = edge[:-2] & ~edge[1:-1] & edge[2:]
        between = np.zeros(len(sym), bool)
        between[2:-1] = edge[2:-1] & one[1:-2] & one[3:]
        chain = between.copy()
        chain[2:] |= between[:-2]
        chain[:-2] |= between[2:]
        three = np.zeros(len(sym), bool)
        three[2:] |= between[2:] & between[:-2]
        three[:-2] |= between[:-2] & between[2:]
        drop |= three
    sym, doc = sym[~drop], doc[~drop]
    edges = np.flatnonzero(sym == 0)
    has = np.zeros(len(edges), bool)
    has[:-1] = np.diff(edges) > 1
    at = edges[has]
    if len(at) == 0:
        return Words(np.zeros(1, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # edges that start no word are the ends of a text's last word
    pick = np.ones(len(sym), bool)
    return Words(sym[pick], at, doc[at + 1].astype(np.int64))


def _room(sym: np.ndarray) -> np.ndarray:
    """Symbols from each position to the next edge after it."""
    edges = np.flatnonzero(sym == 0)
    nxt = np.append(edges[1:], len(sym) - 1)
    own = np.cumsum(sym == 0) - 1
    return nxt[np.maximum(own, 0)] - np.arange(len(sym))


def norms(size: np.ndarray) -> np.ndarray:
    """Root of K(x, x) by word length, all subsequences taken as unlike; it has no longest word."""
    places = np.maximum(0, size[:, None] + 2 - np.array([c for _, _, c in OFFSETS]))
    return np.sqrt(np.maximum(1.0, places @ np.array([DECAY ** (2 * (c + 1 - ORDER)) for _, _, c in OFFSETS])))


def position_codes(sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of a subsequence: its code at every position, where it stays inside a word, and its weight."""
    n = max(0, len(sym) - SPAN + 1)
    room = _room(sym)[:n]
    s = sym.astype(np.int32)
    need = {(0, a) for a, _, _ in OFFSETS} | {(b, c) for _, b, c in OFFSETS}
    pairs = {(a, b): s[a : a + n] * SYMBOLS + s[b : b + n] for a, b in need}
    inside = {c: room >= c for c in range(ORDER - 1, SPAN)}
    for a, b, c in OFFSETS:
        yield pairs[0, a] * (SYMBOLS * SYMBOLS) + pairs[b, c], inside[c], DECAY ** (c + 1 - ORDER)


def _padded(sym: np.ndarray) -> np.ndarray:
    return np.concatenate([sym, np.zeros(SPAN, np.uint8)])


def word_scores(words: Words, table: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each word."""
    if not len(words.at):
        return np.zeros(0)
    sym = _padded(words.sym)
    total = np.zeros(len(sym), np.float32)
    n = len(sym) - SPAN + 1
    for code, inside, weight in position_codes(sym):
        total[:n] += np.float32(weight) * np.where(inside, table[code], np.float32(0))
    sums = np.zeros(len(sym) + 1)
    np.cumsum(total, out=sums[1:])
    size = words.size
    return (sums[words.at + size + 1] - sums[words.at]) / norms(size) + bias


def document_features(scores: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document: mean of its three highest word scores, how many words lie above zero and above one half, and their share."""
    out = np.zeros((n, 4))
    out[:, 0] = -1.0
    out[:, 3] = np.log(1e-4)
    if not len(scores):
        return out
    total = np.bincount(doc, minlength=n)
    own = np.flatnonzero(total)
    s = np.clip(scores, -1.5, 1.5)
    order = np.lexsort((-s, doc))
    first = np.concatenate([[0], np.cumsum(total[own])[:-1]])
    top = np.arange(len(order)) - np.repeat(first, total[own]) < 3
    out[own, 0] = (np.bincount(doc[order][top], s[order][top], n) / np.maximum(1, np.minimum(total, 3)))[own]
    hits = np.bincount(doc, np.clip(s, 0, 1), n)[own]
    out[own, 1] = np.log1p(hits)
    out[own, 2] = np.log1p(np.bincount(doc, s > 0.5, n)[own])
    out[own, 3] = np.log(hits / total[own] + 1e-4)
    return out


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, of which whole texts are read, and parameters of the fit."""

    toxic_docs: int = 1500
    clean_docs: int = 3000
    landmarks: int = 384
    ratio: float = 3.0
    ridge: float = 1e-5


def _sparse(sym: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and weight of the subsequences of the words at ``at``."""
    rows, codes, weights, norm = [], [], [], norms(size)
    for a, b, c in OFFSETS:
        n = np.maximum(0, size + 2 - c)
        row = np.repeat(np.arange(len(at)), n)
        p = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(row))
        s = sym.astype(np.int32)
        codes.append(((s[p] * SYMBOLS + s[p + a]) * SYMBOLS + s[p + b]) * SYMBOLS + s[p + c])
        rows.append(row)
        weights.append(DECAY ** (c + 1 - ORDER) / norm[row])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights).astype(np.float32)


def _kernel(parts: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, known: np.ndarray, z: np.ndarray) -> np.ndarray:
    """K(x, z_l) of n words with all landmarks; ``z`` has the landmarks' weights for the codes ``known``."""
    row, code, weight = parts
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    hit = known[at] == code
    row, at, weight = row[hit], at[hit], weight[hit]
    order = np.argsort(row, kind="stable")
    row, at, weight = row[order], at[order], weight[order]
    out = np.zeros((n, z.shape[1]), np.float32)
    for a in range(0, len(row), 40_000):
        some = slice(a, a + 40_000)
        first = np.flatnonzero(np.diff(row[some], prepend=-1))
        out[row[some][first]] += np.add.reduceat(z[at[some]] * weight[some, None], first, axis=0)
    return out


def _svm(x: np.ndarray, up: np.ndarray, down: np.ndarray, ridge: float, steps: int = 12, part: int = 20_000) -> np.ndarray:
    """Squared-hinge linear SVM with a bias, each row with a weight as positive and one as negative, by Newton steps."""
    n = x.shape[1]
    w = np.zeros(n + 1)
    w[-1] = -1
    penalty = np.append(np.full(n, ridge), 1e-9)
    for _ in range(steps):
        left, right = np.diag(penalty), np.zeros(n + 1)
        for i in range(0, len(x), part):
            rows = np.hstack([x[i : i + part], np.ones((len(x[i : i + part]), 1), x.dtype)])
            f = rows @ w
            a, b = np.where(f < 1, up[i : i + part], 0), np.where(f > -1, down[i : i + part], 0)
            left = left + (rows * (a + b)[:, None]).T @ rows
            right += rows.T @ (a - b)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-4
        w = new
        if done:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3e-3) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.ones(x.shape[1] - 1), 0)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w * keep
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge * keep + 1e-6)
        w = w - np.linalg.solve(h, g)
    return w


def doc_words(texts: list[str | None]) -> list[set[bytes]]:
    """The distinct words of over two letters of each text, as the symbols from their opening edge on."""
    out: list[set[bytes]] = []
    for text in texts:
        found: set[bytes] = set()
        for part in parts_of(text):
            words = word_stream([part])
            raw = words.sym.tobytes()
            found.update(raw[a : a + n + 1] for a, n in zip(words.at.tolist(), words.size.tolist()) if n > 2)
        out.append(found)
    return out


def train(known: list[bytes], up: np.ndarray, down: np.ndarray, n_up: int, n_down: int, setting: Training = Training()) -> tuple[np.ndarray, float]:
    """Weight table of the subsequences and the bias, from distinct words and how many toxic and clean documents have them.

    A sentence has its document's label and each of its words is an example under that label, once for a document;
    a word's weight as positive is its share of the toxic documents, as negative ``ratio`` times its share of the
    others.  Half of the landmarks are the words that lean most to the toxic side, half are drawn from all.
    """
    table = np.zeros(SYMBOLS**ORDER, np.float32)
    if not known:
        return table, -1.0
    rng = np.random.default_rng(11)
    sym = np.frombuffer(b"".join(known) + b"\0", np.uint8)
    size = np.array([len(w) - 1 for w in known], np.int64)
    at = np.cumsum(size + 1) - size - 1
    lean = up * np.log(((up + 0.5) / max(1, n_up)) / ((down + 0.5) / max(1, n_down)))
    half = setting.landmarks // 2
    marks = np.unique(np.concatenate([np.argsort(-lean, kind="stable")[:half], rng.permutation(len(at))[: setting.landmarks - half]]))
    sym = _padded(sym)
    row, code, weight = _sparse(sym, at[marks], size[marks])
    codes, place = np.unique(code, return_inverse=True)
    z = np.zeros((len(codes), len(marks)), np.float32)
    np.add.at(z, (place, row), weight)
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    some = values > values[-1] * 1e-6
    root = (vectors[:, some] / np.sqrt(values[some])).astype(np.float32)
    parts = [slice(i, i + 20_000) for i in range(0, len(at), 20_000)]
    x = np.concatenate([_kernel(_sparse(sym, at[p], size[p]), len(at[p]), codes, z) @ root for p in parts])
    w = _svm(x, up / max(1, n_up), setting.ratio * down / max(1, n_down), setting.ridge)
    table[codes] = z @ (root @ w[:-1]).astype(np.float32)
    return table, float(w[-1])


#: Texts longer than this are scored part by part.
LONG_TEXT = 1 << 20
_BETWEEN = re.compile(r"(?<=\w\w)\s+(?=\w\w)")


def parts_of(text: str | None, most: int = LONG_TEXT) -> list[str | None]:
    """A text in parts of ``most`` characters and some more, cut between two words of two letters or more."""
    if not text or len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most and (gap := _BETWEEN.search(text, at + most)):
        out.append(text[at : gap.start()])
        at = gap.end()
    return [*out, text[at:]]


def text_features(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Document features of whole texts; of a long one only its word scores are held at once."""
    cut = [parts_of(t) for t in texts]
    if all(len(p) == 1 for p in cut):
        words = word_stream(texts)
        return document_features(word_scores(words, table, bias), words.doc, len(texts))
    scores, doc = [], []
    for i, parts in enumerate(cut):
        for part in parts:
            own = word_scores(word_stream([part]), table, bias).astype(np.float32)
            scores.append(own)
            doc.append(np.full(len(own), i, np.int64))
    return document_features(np.concatenate(scores), np.concatenate(doc), len(texts))


def score_texts(texts: list[str | None], table: np.ndarray, head: np.ndarray) -> np.ndarray:
    if len(head) == 1:  # no two classes to tell apart
        return np.full(len(texts), 1 / (1 + np.exp(-head[0])))
    f = text_features(texts, table, head[-1])
    return 1 / (1 + np.exp(-np.clip(f @ head[:-2] + head[-2], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, setting: Training, doc_id: str, text: str) -> DataFrame:
    """The bounded labelled sample (t, y, fits): of each class the documents with the lowest hashes, fold 0 left out.

    ``fits`` marks two thirds, which train the machine; its scores on the rest train the document score.
    """
    known = labels.where("toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    # at most toxic_docs + clean_docs ids: the broadcast has that bound
    ids = known.where("y = 1").orderBy(order, "doc_id").limit(setting.toxic_docs).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(setting.clean_docs))
    some = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(ids), F.col("id") == F.col("doc_id"))
    return some.groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) != 0).alias("fits"))


def fitted(rows: DataFrame, setting: Training) -> tuple[np.ndarray, np.ndarray]:
    """Weight table, and the coefficients that turn document features into a score, of a sample.

    Words are made and counted where the sample's texts lie; one task fits the machine on the distinct words that
    two documents or more have, and the document features of at most the sample's rows reach the driver.
    """
    rows = materialize(rows, "sample")
    count = {(r["y"], r["fits"]): r["n"] for r in rows.groupBy("y", "fits").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (y, _), n in count.items() if y == k) for k in (0, 1)]
    if not all(total):
        return np.zeros(SYMBOLS**ORDER, np.float32), np.array([30.0 if total[1] else -30.0])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t", 1 << 19):
            own = doc_words(piece.column("t").to_pylist())
            y = np.repeat(np.asarray(piece.column("y")), [len(w) for w in own])
            yield pa.RecordBatch.from_arrays([pa.array([w for d in own for w in d], pa.binary()), pa.array(y, pa.int32())], ["w", "y"])

    counts = map_texts(rows.where("fits").select("t", "y"), words, "w binary, y int").groupBy("w").agg(F.sum("y").alias("up"), F.sum(1 - F.col("y")).alias("down")).where("up + down >= 2")
    n_down, n_up = count.get((0, True), 0), count.get((1, True), 0)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[bytes, int, int]] = []
        for b in batches:
            known += zip(b.column("w").to_pylist(), b.column("up").to_pylist(), b.column("down").to_pylist())
        known.sort()
        up, down = (np.array([k[i] for k in known], np.float64) for i in (1, 2))
        table, bias = train([bytes(k[0]) for k in known], up, down, n_up, n_down, setting)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([bias])], ["w", "b"])
        del known
        release()

    got = materialize(counts.repartition(1).mapInArrow(fit, "w binary, b double"), "toxicity").first()
    table, bias = (np.frombuffer(bytes(got["w"]), np.float32), got["b"]) if got is not None else (np.zeros(SYMBOLS**ORDER, np.float32), -1.0)
    sent = rows.sparkSession.sparkContext.broadcast(table.tobytes())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.float32)
        for piece in slices(batches, "t", 1 << 19):
            f = text_features(piece.column("t").to_pylist(), held, bias)
            yield pa.RecordBatch.from_arrays([piece.column("y"), piece.column("fits"), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))], ["y", "fits", "f"])

    seen = sorted(map(tuple, map_texts(rows, features, "y int, fits boolean, f array<double>").collect()))
    y, fits, f = np.array([r[0] for r in seen]), np.array([r[1] for r in seen]), np.array([r[2] for r in seen])
    held = ~fits if 0 < y[~fits].sum() < (~fits).sum() else np.ones(len(y), bool)
    return table, np.append(_logistic(f[held], y[held]), bias)


def score_documents(docs: DataFrame, labels: DataFrame, setting: Training = Training(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text.

    ``labels`` (doc_id, toxic) trains on the whole texts of a bounded sample of its rows, ``Training`` documents the
    bounds, and never on rows with crc32(doc_id) mod 5 = 0.  The machine's 4 MB table is broadcast.

    * Null and empty texts have no sentence and get the score of none.  A null doc_id is not held out.  Equal
      texts score alike.  With no labels, or labels of one class, every score is near that class (0 for none).
      No rows give an empty result.  Columns other than doc_id and text are not read.
    """
    table, head = fitted(sample(docs, labels, setting, doc_id, text), setting)
    model = docs.sparkSession.sparkContext.broadcast((table.tobytes(), head.tobytes()))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, head = np.frombuffer(model.value[0], np.float32), np.frombuffer(model.value[1], np.float64)
        for piece in slices(batches, "t", 1 << 19):
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(score_texts(piece.column("t").to_pylist(), table, head))], [doc_id, "score"])

    scored = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    scored = map_texts(scored, run, f"`{doc_id}` {kind}, score double")
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
    return scored.select(doc_id, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
