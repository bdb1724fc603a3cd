"""Token counts by section: whole documents are encoded once and token spans are interval-joined to sections."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import map_texts, slices, utf8

RULES = ("first", "last", "most", "split")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space from this length on are cut out of a text: the library's pattern has no stack for long ones.
LONG_RUN = 4096
#: The white space of the library's pattern.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

_ENCODERS: dict[int, tuple] = {}
_PAIRS: dict[int, list] = {}


def encoder(data: bytes):
    """The byte-level BPE of a rank file and the byte length of each token; kept by worker."""
    if (held := _ENCODERS.get(hash(data))) is None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        held = _ENCODERS[hash(data)] = (tiktoken.Encoding("weft", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)
    return held


class _Pairs:
    """Merges of one long piece: what the encoder does with it, over arrays instead of a list that is searched again and again."""

    def __init__(self, enc):
        self.ranks = enc._mergeable_ranks
        size = max(self.ranks.values()) + 1
        self.bytes = np.zeros(256, np.int64)
        for b in range(256):
            self.bytes[b] = self.ranks[bytes([b])]
        known = [(self.ranks[w[:k]] * size + self.ranks[w[k:]], r) for w, r in self.ranks.items() for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        known.sort()
        self.size, self.keys, self.made = size, np.array([k for k, _ in known], np.int64), np.array([r for _, r in known], np.int64)

    def encode(self, piece: bytes) -> np.ndarray:
        """Ranks of the merged piece.  All places of the best pair merge at once, the left of two that overlap, as one by one they would."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            key = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.made[at], np.iinfo(np.int64).max)
            best = rank.min()
            if best == np.iinfo(np.int64).max:
                break
            # one rank is one string, but it may be made of different pairs; the leftmost place comes first whatever the pair
            place = np.flatnonzero(rank == best)
            first = np.flatnonzero(np.diff(place, prepend=-2) > 1)
            nth = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
            place = place[nth % 2 == 0]
            ids[place] = best
            ids = np.delete(ids, place + 1)
        return ids


def encode(enc, text: str | None, pairs: list | None = None) -> np.ndarray:
    """Token ids of a whole text, as the library gives them, for runs of white space of any length too.

    Before a word the pattern takes all of a run but its last character as one piece, at the end of a text all of
    it, and no piece reaches over a run's start; so a long run is merged by itself between the parts.
    """
    out, at = [], 0
    for run in _RUN.finditer(text or ""):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(enc.encode_ordinary(text[at : run.start()]))
        if pairs is None:
            pairs = []
        if not pairs:
            pairs.append(_Pairs(enc))
        out.append(pairs[0].encode(text[run.start() : end].encode("utf-8", "surrogatepass")))
        at = end
    out.append(enc.encode_ordinary(text[at:]) if text else [])
    return np.concatenate([np.asarray(x, np.int64) for x in out])


def line_sections(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions where sections start: each text and each line; a line keeps its line feed."""
    starts = np.union1d(np.flatnonzero(raw == 0x0A) + 1, at[:-1])
    return starts[starts < len(raw)]


def allocate(token_start: np.ndarray, token_end: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under a rule, and the tokens that cross into it from the one before.

    Spans are half-open; ``sections`` are the sorted starts of adjoining sections.  A token inside one section
    counts there.  One that crosses boundaries counts in the section of its first position (``first``), of its last
    (``last``), in the one that holds most of it, the earlier of equals (``most``), or in each by the
    share it holds (``split``).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    n = len(sections)
    a = np.searchsorted(sections, token_start, side="right") - 1
    b = np.searchsorted(sections, token_end - 1, side="right") - 1
    crossing = np.flatnonzero(b > a)
    crossed = np.zeros(n, np.int64)
    owner = b if rule == "last" else a
    if rule in ("first", "last"):
        counts = np.bincount(owner, minlength=n).astype(np.float64)
    else:
        counts = np.bincount(a[b == a], minlength=n).astype(np.float64)
    for i in crossing.tolist():
        s, e = int(token_start[i]), int(token_end[i])
        cuts = [s, *sections[a[i] + 1 : b[i] + 1].tolist(), e]
        crossed[a[i] + 1 : b[i] + 1] += 1
        held = np.diff(cuts)
        if rule == "most":
            counts[a[i] + int(np.argmax(held))] += 1
        elif rule == "split":
            counts[a[i] : b[i] + 1] += held / (e - s)
    return counts, crossed


def section_counts(column: pa.Array, data: bytes, rule: str) -> dict[str, np.ndarray]:
    """For each section of each text: row, section, from_char, to_char, tokens, crossing."""
    enc, lengths = encoder(data)
    pairs = _PAIRS.setdefault(hash(data), [])
    raw, at = utf8(column)
    ids = [encode(enc, t, pairs) for t in column.to_pylist()]
    width = lengths[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
    end = np.cumsum(width)
    start = end - width
    sections = line_sections(raw, at)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    # a token that holds part of a character spans that character
    lead = lambda p: chars[p + 1] - 1
    counts, crossed = allocate(lead(start), lead(end - 1) + 1, chars[sections], rule)
    doc = np.searchsorted(at, sections, side="right") - 1
    ends = np.append(sections[1:], len(raw))
    base = chars[at[doc]]
    empty = np.flatnonzero(np.diff(at) == 0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    zero = np.zeros(len(empty), np.int64)
    both = lambda x: np.concatenate([x, zero])
    return {"row": np.concatenate([doc, empty]), "section": both(nth), "from_char": both(chars[sections] - base), "to_char": both(chars[ends] - base), "tokens": np.concatenate([counts, zero.astype(float)]), "crossing": both(crossed)}


def attribute_tokens(docs: DataFrame, vocabulary: str | None = None, rule: str = "first", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each line of each text: doc_id, section, from_char, to_char, tokens (double), crossing.

    The whole text is encoded once, so a token may cross lines; ``rule`` says where it counts (see
    ``allocate``) and ``crossing`` counts those that enter a section from before.  Under every rule a
    document's sections sum to its tokens.

    * A null or empty text has one section of no characters and no tokens.  Repeated rows and a null doc_id
      stay as they are.  No rows give an empty result.  Other columns are not read.
    * Row by row: no shuffle, one piece of about 1 MB of text (or one longer text) in memory.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    data = docs.sparkSession.sparkContext.broadcast(vocab.read(vocabulary, "byte_bpe_50k.tiktoken"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t"):
            got = section_counts(piece.column("t"), data.value, rule)
            ids = piece.column("id").take(pa.array(got.pop("row"), pa.int64()))
            kinds = {"section": pa.int32(), "tokens": pa.float64()}
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items())], [doc_id, *got])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    return map_texts(rows, run, f"`{doc_id}` {kind}, section int, from_char long, to_char long, tokens double, crossing long")
