"""Change tracking between two versions of a page: baselines, words, lines, links, images, structure, advice."""

from __future__ import annotations

import difflib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import similarity as S
from ..functions import text as T

#: Tags of the sections of a page.
SECTIONS = ("header", "nav", "main", "article", "section", "aside", "footer")


def baseline(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, version 1, content hash and length, and a map of the hashes of the page's sections by tag and ordinal."""
    def hashed(tag: str) -> Column:
        found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), F.lit(0))
        return F.transform(found, lambda x, i: F.struct(F.concat(F.lit(f"{tag}_"), i.cast("string")).alias("k"), S.content_hash(x).alias("v")))

    found = [hashed(tag) for tag in SECTIONS]
    return pages.select(url, F.lit(1).alias("version"), S.content_hash(F.col(html)).alias("content_hash"), F.length(html).alias("content_length"), F.map_from_entries(F.concat(*found)).alias("sections"))


def _keyed(found: Column, key: str, *values: str) -> Column:
    """Entries of an array of structs by key, the last of equal keys."""
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y[key] == x[key]))


def keyed_changes(old: Column, new: Column, key: str, *values: str) -> dict[str, Column]:
    """Entries added, removed and modified between two arrays of structs, told apart by ``key`` and compared by ``values``."""
    a, b = _keyed(old, key), _keyed(new, key)
    changed = lambda x, y: (x[key] == y[key]) & ~F.struct(*(x[v] for v in values)).eqNullSafe(F.struct(*(y[v] for v in values)))
    return {
        "added": F.filter(b, lambda x: ~F.exists(a, lambda y: y[key] == x[key])),
        "removed": F.filter(a, lambda x: ~F.exists(b, lambda y: y[key] == x[key])),
        "modified": F.filter(b, lambda x: F.exists(a, lambda y: changed(x, y))),
    }


def tags(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(H.live(html), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)


def structural_similarity(old: Column, new: Column) -> Column:
    """Mean of the similarity of the sets of tags and of the hierarchy, which counts as kept; 1 for no elements, 0 if one has none."""
    both = F.struct(tags(old).alias("a"), tags(new).alias("b"))
    return T.let(both, lambda x: F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), 1.0).when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise((S.jaccard(F.array_distinct(x["a"]), F.array_distinct(x["b"])) + 1) / 2))


def differing_words(old: Column, new: Column) -> dict[str, Column]:
    """Words, repeats included, of the new text that the old has not, and the other way round."""
    a, b = F.split(old, r"\s+"), F.split(new, r"\s+")
    return {"added": T.let(F.struct(F.array_except(b, a).alias("x"), b.alias("b")), lambda s: F.filter(s["b"], lambda w: F.array_contains(s["x"], w))), "removed": T.let(F.struct(F.array_except(a, b).alias("x"), a.alias("a")), lambda s: F.filter(s["a"], lambda w: F.array_contains(s["x"], w)))}


def significance_score(additions: Column, deletions: Column, modifications: Column, added: Column, removed: Column, length: Column) -> Column:
    """0.4 of the share of changed text and 0.6 of changed elements over twenty, one at most."""
    text = (additions + deletions + modifications) / F.when(F.coalesce(length, F.lit(0)) == 0, 1000).otherwise(length)
    return F.least(F.lit(1.0), 0.4 * text + 0.6 * (added + removed) / 20)


def recommendations(level: Column, kind: Column, similarity: Column) -> Column:
    """Advice on a change: array of (type, priority, message)."""
    advice = [
        (level == "critical", "alert", "high", "Critical changes detected. Manual review recommended."),
        (kind == "structural", "monitoring", "medium", "Structural changes may affect scraping selectors."),
        (similarity < 0.5, "analysis", "medium", "Low content similarity suggests major content changes."),
    ]
    rows = F.array(*(F.when(test, F.struct(F.lit(t).alias("type"), F.lit(p).alias("priority"), F.lit(m).alias("message"))) for test, t, p, m in advice))
    return F.filter(rows, lambda r: r.isNotNull())


def summary(level: Column, kind: Column, added: Column, removed: Column, modified: Column) -> Column:
    """One line on a change."""
    return F.when(level == "none", "No changes").otherwise(F.concat(F.initcap(level), F.lit(" "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(": "), F.concat_ws(", ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {w}"))) for n, w in ((added, "added"), (removed, "removed"), (modified, "modified"))))))


def update_stats(changes: DataFrame) -> DataFrame:
    """One row over changes (significance, change_type, similarity, timestamp): counts, mean similarity, last analysis."""
    return changes.agg(
        F.count("*").alias("changes_detected"), F.count_if(F.col("significance") != "none").alias("significant"), F.count_if(F.col("change_type") == "structural").alias("structural"),
        F.count_if(F.col("change_type") != "structural").alias("content"), F.avg("similarity").alias("average_score"), F.max("timestamp").alias("last_analysis"),
    )


class _Blocks(difflib.SequenceMatcher):
    """The blocks of ``SequenceMatcher`` without junk, found by hashes of runs: the longest, then the first in a, then in b."""

    #: Up to this many pairs of units are compared one by one.
    FEW = 1024

    def __init__(self, a: list[str], b: list[str]) -> None:
        super().__init__(None, "", "", autojunk=False)
        self.a, self.b = a, b
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(u, len(known)) for u in itertools.chain(a, b)], np.uint64)
        self.ia, self.ib = ids[: len(a)], ids[len(a) :]
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), 0xD6E8FEB86659FD93, np.uint64)])
        # sums of unit * power; times the power left to a common exponent, those of equal runs are equal
        sums = lambda m: np.r_[np.uint64(0), np.cumsum(m * self.power[: len(m)])]
        self.sa, self.sb = sums(mixed[: len(a)]), sums(mixed[len(a) :])

    def _runs(self, sums: np.ndarray, lo: int, hi: int, size: int) -> np.ndarray:
        """Hashes of the runs of ``size`` units within lo..hi."""
        top = max(len(self.a), len(self.b))
        return (sums[lo + size : hi + 1] - sums[lo : hi + 1 - size]) * self.power[top - hi + size : top - lo + 1][::-1]

    def _at(self, alo: int, ahi: int, blo: int, bhi: int, size: int) -> tuple[int, int] | None:
        """The first run of a of this size that b has, and the first such of b."""
        ha, hb = self._runs(self.sa, alo, ahi, size), self._runs(self.sb, blo, bhi, size)
        has = np.isin(ha, hb)
        i = int(has.argmax())
        return (alo + i, blo + int((hb == ha[i]).argmax())) if has[i] else None

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        most = min(ahi - alo, bhi - blo)
        if (ahi - alo) * (bhi - blo) > self.FEW:
            differ = np.flatnonzero(self.ia[alo : alo + most] != self.ib[blo : blo + most])
            size, best = int(differ[0]) if len(differ) else most, (alo, blo)
            if not size:
                best = None
            # size is reached by best; longer ones are sought just above it and in the middle by turns
            over, near = most + 1, True
            while size + 1 < over:
                tried = size + 1 if near else (size + over) // 2
                found = self._at(alo, ahi, blo, bhi, tried)
                if found is None:
                    over = tried
                else:
                    i, j = found
                    long = min(ahi - i, bhi - j)
                    differ = np.flatnonzero(self.ia[i : i + long] != self.ib[j : j + long])
                    size, best = int(differ[0]) if len(differ) else long, found
                    if size < tried:
                        break
                near = not near
            else:
                if size:
                    best = self._at(alo, ahi, blo, bhi, size)
                    if (self.ia[best[0] : best[0] + size] == self.ib[best[1] : best[1] + size]).all():
                        return difflib.Match(*best, size)
                else:
                    return difflib.Match(alo, blo, 0)
        # few units, or two unlike runs of one hash
        i, j, size = difflib.SequenceMatcher(None, self.a[alo:ahi], self.b[blo:bhi], autojunk=False).find_longest_match()
        return difflib.Match(alo + i, blo + j, size)


def diff(old: list[str], new: list[str]) -> list[dict]:
    """Runs of units added and removed, in order."""
    out = []
    if old == new:
        return out
    for op, a, b, c, d in _Blocks(old, new).get_opcodes():
        if op in ("delete", "replace"):
            out.append({"removed": True, "count": b - a, "value": "".join(old[a:b])})
        if op in ("insert", "replace"):
            out.append({"added": True, "count": d - c, "value": "".join(new[c:d])})
    return out


def text_changes(pairs: DataFrame, key: str, old: str, new: str, ignore_whitespace: bool = False, ignore_case: bool = False) -> DataFrame:
    """key, word_diff and line_diff (JSON arrays of runs added and removed) of two texts, in Arrow batches."""
    kind = pairs.schema[key].dataType.simpleString()

    def plain(text: str | None) -> str:
        text = re.sub(r"\s+", " ", text or "").strip() if ignore_whitespace else text or ""
        return text.lower() if ignore_case else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lines = [], []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = plain(a), plain(b)
                words.append(json.dumps(diff(re.findall(r"\s+|\w+|[^\w\s]", a), re.findall(r"\s+|\w+|[^\w\s]", b)), ensure_ascii=False))
                lines.append(json.dumps(diff(a.splitlines(keepends=True), b.splitlines(keepends=True)), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), pa.array(lines, pa.string())], [key, "word_diff", "line_diff"])

    return pairs.select(key, old, new).mapInArrow(run, f"`{key}` {kind}, word_diff string, line_diff string")
