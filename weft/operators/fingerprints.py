"""64-bit SimHash of whole texts in Arrow batches: FNV-1a of all tokens of a text side by side."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

_SPACE, _SPACE_SQL = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[ \t\n\f\r]+")
#: Offset bases of the low and the high word, and the prime.
BASES, PRIME = (0x811C9DC5, 0x84222325), np.uint32(0x01000193)


def fnv1a(tokens: list[str], basis: int, points: bool = False) -> np.ndarray:
    """FNV-1a over the UTF-16 units (or code points) of each token; tokens with a next unit are a prefix, as they are ordered by length."""
    code, kind = ("utf-32-le", np.uint32) if points else ("utf-16-le", np.uint16)
    units = [np.frombuffer(t.encode(code, "surrogatepass"), kind) for t in tokens]
    size = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate([*units, np.zeros(1, kind)]).astype(np.uint32)
    at = (np.cumsum(size) - size)[order]
    h = np.full(len(tokens), basis, np.uint32)
    left = size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))
        h[:n] = (h[:n] ^ flat[at[:n] + k]) * PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def simhash(text: str | None, points: bool = False) -> int | None:
    """A bit is set if more tokens, repeats counted, have it than not; signed.  With ``points`` as DuckDB's SQL: code points, a vertical tab is no space."""
    if text is None:
        return None
    tokens = (_SPACE_SQL if points else _SPACE).split(text)
    known = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    weight = np.bincount([known[t] for t in tokens], minlength=len(known))
    out = 0
    for word, basis in enumerate(BASES):
        h = fnv1a(list(known), basis, points)
        bits = (h[:, None] >> np.arange(32, dtype=np.uint32)) & 1
        total = (weight[:, None] * (2 * bits.astype(np.int64) - 1)).sum(0)
        out |= sum(1 << (32 * word + b) for b in range(32) if total[b] > 0)
    return out - (1 << 64) if out >> 63 else out


def with_simhash(rows: DataFrame, text: Column, key: str = "doc_id", name: str = "simhash", points: bool = False) -> DataFrame:
    """``key`` and the SimHash of a whole text column."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t, points) for t in batch.column(1).to_pylist()], pa.int64())], [key, name])

    return rows.select(key, text.alias("text")).mapInArrow(run, f"`{key}` {kind}, `{name}` long")
