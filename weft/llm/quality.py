"""Host-level quality rules: rule failures by host, empirical beta shrinkage, verdicts joined back to documents."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHashes, counted, fresh, join_heavy, make_room, map_texts, powers, slices, utf8, words

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "gross_failed", "soft_failed", "host_rate", "host_rejected", "kept")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Thresholds:
    """Rules as shares of words, and the verdict on a host.

    ``gross_*`` rules reject a document anywhere; ``soft_*`` rules count towards its host's failure rate and
    reject a document only under a host whose shrunk rate reaches ``host_rate``.
    """

    min_words: int = 20
    max_repeat: float = 0.30
    gross_symbols: float = 0.30
    gross_dup_lines: float = 0.10
    soft_symbols: float = 0.10
    soft_dup_lines: float = 0.03
    soft_repeat: float = 0.15
    soft_word_chars: tuple[float, float] = (2.0, 15.0)
    host_rate: float = 0.5


def _per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per byte) over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _alike(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    near = np.searchsorted(twice, keys)
    return twice[np.minimum(near, len(twice) - 1)] == keys


def repeat_words(tokens: list[bytes], maybe: np.ndarray | None = None, window: int = WINDOW) -> int:
    """Words inside windows found twice or more; ``maybe`` are the window starts worth a look."""
    at = range(len(tokens) - window + 1) if maybe is None else maybe
    seen = [tuple(tokens[i : i + window]) for i in at]
    count = Counter(seen)
    covered = np.zeros(len(tokens) + 1, np.int64)
    for i, w in zip(at, seen):
        if count[w] > 1:
            covered[i] += 1
            covered[min(len(tokens), i + window)] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def dup_lines(body: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in body.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """The five base counts of each text.  Hashes only find candidates; exact comparison decides."""
    raw, at = utf8(column)
    n = len(at) - 1
    starts, ends, doc = words(raw, at)
    n_words = np.bincount(doc, minlength=n).astype(np.int64)
    lead = (raw & 0xC0) != 0x80
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=sums[1:])
    word_chars = np.zeros(n, np.int64)
    np.add.at(word_chars, doc, sums[ends] - sums[starts]) if len(doc) else None
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _per_doc(_SYMBOL[raw], at), "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    hashes = SpanHashes(raw)
    mix = powers(np.uint64(0xD6E8FEB86659FD93), n + 1)[1:]

    feeds = np.flatnonzero(raw == 0x0A)
    line_starts = np.union1d(feeds + 1, at[:-1])
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.minimum(np.append(line_starts[1:], len(raw)), len(raw))
    line_ends = line_ends - (raw[line_ends - 1] == 0x0A) if len(line_ends) else line_ends
    some = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[some], line_ends[some]
    line_doc = np.searchsorted(at, line_starts, side="right") - 1
    keys = hashes.of(line_starts, line_ends) ^ mix[line_doc]
    for d in np.unique(line_doc[_alike(keys)]):
        out["n_dup_lines"][d] = dup_lines(raw[at[d] : at[d + 1]].tobytes())

    if len(starts) > WINDOW:
        h = hashes.of(starts, ends)
        first = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        keys = np.zeros(len(first), np.uint64)
        for j in range(WINDOW):
            keys = keys * np.uint64(0x9FB21C651E98DF25) + h[first + j]
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) ^ mix[doc[first]]
        maybe = first[_alike(keys)]
        base = np.searchsorted(doc, np.arange(n + 1))
        for d, own in zip(*_runs(doc[maybe], maybe)):
            tokens = raw[at[d] : at[d + 1]].tobytes().split()
            out["n_repeat_words"][d] = repeat_words(tokens, own - base[d])
    return out


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    cut = np.flatnonzero(np.diff(keys)) + 1
    return [int(keys[i]) for i in [0, *cut]], np.split(values, cut)


def base_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the base counts of each whole text; a null text has no words."""
    column = text if text in keep else "__text"
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.select(*keep).schema)}, {FEATURES}"

    def run(batches):
        for piece in slices(batches, column):
            got = features(piece.column(column))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *(pa.array(v, pa.int64()) for v in got.values())], [*keep, *got])

    own = [] if text in keep else [F.col(text).alias(column)]
    return map_texts(docs.select(*keep, *own), run, schema)


#: Hosts up to this number (some MB) are broadcast to meet their documents; beyond it both sides are shuffled.
BROADCAST_HOSTS = 50_000


def beta_prior(hosts: DataFrame) -> tuple[float, float, int]:
    """Alpha and beta of the hosts' failure rates by the method of moments, and the number of hosts; four sums reach the driver.

    Each host weighs as its rows.  Where rates do not vary beyond chance the prior is worth the documents of
    a mean host.
    """
    m = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.count("*").alias("h"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("s")).first()
    if not m["n"]:
        return 1.0, 1.0, 0
    p, mean = m["f"] / m["n"], m["n"] / m["h"]
    between = m["s"] / m["n"] - p * p - p * (1 - p) / mean
    size = min(mean, max(1.0, p * (1 - p) / between - 1)) if between > 1e-9 else mean
    return p * size, (1 - p) * size, m["h"]


def verdicts(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: Thresholds = Thresholds()) -> DataFrame:
    """Base counts, base verdict, host verdict and final verdict of every document.

    Failures of the soft rules are summed by host, each host's rate is shrunk towards an empirical beta prior,
    and the verdict (``host_rejected``) is joined back.  A document stays unless it fails a base or gross rule,
    or fails a soft rule under a rejected host; a document that fails no rule always stays.

    * Null and empty texts have no words and fail; a null host is a host of its own.  Repeated rows are judged one
      by one.  No rows give an empty result.  Columns of the input outside ``keep``, host and text are not read; one
      in ``keep`` that is called as a result becomes ``input_<name>``.
    * Host sums are combined before the shuffle.  Host verdicts are broadcast up to ``BROADCAST_HOSTS`` hosts; with more,
      only those of hosts with many rows are, so a host with a third of all rows needs no task of its own.
    """
    own = list(dict.fromkeys(keep))
    docs = make_room(docs.select(*dict.fromkeys([*own, host, text])), *RESULTS)
    away = dict(zip(dict.fromkeys([*own, host, text]), docs.columns))
    keep, host, text = [away[c] for c in own], away[host], away[text]
    at, h, count = fresh(docs, "host_key", "host_failed", "host_rows")
    known = docs.withColumn(at, F.when(F.col(host).isNull(), "").otherwise(F.concat(F.lit("="), F.col(host).cast("string"))))
    rows, seen = counted(base_features(known, [*keep, at], text), "quality")
    n = F.col("n_words")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > round(100 * rules.max_repeat) * n)
    gross = (F.col("n_symbols") > rules.gross_symbols * n) | (F.col("n_dup_lines") > rules.gross_dup_lines * n)
    length = F.col("word_chars") / F.greatest(n, F.lit(1))
    soft = (F.col("n_symbols") > rules.soft_symbols * n) | (F.col("n_dup_lines") > rules.soft_dup_lines * n) | (F.col("n_repeat_words") > rules.soft_repeat * n) | (length < rules.soft_word_chars[0]) | (length > rules.soft_word_chars[1])
    rows = rows.withColumn("base_failed", base).withColumn("gross_failed", gross).withColumn("soft_failed", base | gross | soft)
    hosts = rows.groupBy(at).agg(F.count("*").alias(count), F.sum(F.col("soft_failed").cast("long")).alias(h))
    alpha, beta, n_hosts = beta_prior(hosts.select(F.col(count).alias("n"), F.col(h).alias("failed")))
    hosts = hosts.select(at, count, ((F.col(h) + alpha) / (F.col(count) + alpha + beta)).alias("host_rate"))
    judged = rows.join(F.broadcast(hosts.drop(count)), at) if n_hosts <= BROADCAST_HOSTS else join_heavy(rows, hosts, at, seen["n"], count)
    judged = judged.drop(at).withColumn("host_rejected", F.col("host_rate") >= rules.host_rate)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("gross_failed") & ~(F.col("soft_failed") & F.col("host_rejected")))
