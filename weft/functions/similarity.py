"""Similarity and hashing scalars as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def byte_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the UTF-8 bytes, as in DuckDB: each byte becomes one character."""
    one = lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(one(a), one(b))


def edit_similarity(a: Column, b: Column, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """One less the distance over the characters of the longer; below 0 where a distance in bytes exceeds these."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - distance(a, b) / longest)


def title_similarity(a: Column, b: Column, tokens_a: Column, tokens_b: Column, distance: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """0.7 of the token Jaccard and 0.3 of the edit similarity; 0 if one is empty, 1 if equal."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    union = F.greatest(F.size(F.array_union(tokens_a, tokens_b)), F.lit(1))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(0.7 * F.size(F.array_intersect(tokens_a, tokens_b)) / union + 0.3 * edit_similarity(x, y, distance))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fnv1a32(s: Column, basis: int) -> Column:
    """FNV-1a over the UTF-16 units of a string, as a non-negative long."""
    units = F.hex(F.encode(s, "UTF-16BE"))
    at = F.when(F.length(units) > 0, F.sequence(F.lit(1), F.length(units), F.lit(4))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(at, lambda i: F.conv(F.substr(units, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(basis).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(0x01000193).cast("long"), F.lit(1 << 32)))


def simhash64(text: Column) -> Column:
    """64-bit SimHash over white-space tokens with repeats: low word by one FNV basis, high word by another; a bit is set if its sum is positive."""
    tokens = F.split(text, r"\s+")
    hashes = F.transform(tokens, lambda t: F.struct(fnv1a32(t, 0x811C9DC5).alias("lo"), fnv1a32(t, 0x84222325).alias("hi")))
    zero = F.array_repeat(F.lit(0), 64)
    step = lambda acc, h: F.transform(acc, lambda v, i: v + F.when(F.when(i < 32, F.getbit(h["lo"], i)).otherwise(F.getbit(h["hi"], i - 32)) == 1, 1).otherwise(-1))
    sums = F.aggregate(hashes, zero, step)
    return F.aggregate(F.transform(sums, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero; vectors of unlike length raise an error."""
    same = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("boolean"))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(same & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two token arrays."""
    terms = F.array_union(a, b)
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t)).cast("double")
    va, vb = F.transform(terms, lambda t: count(a, t)), F.transform(terms, lambda t: count(b, t))
    return cosine(va, vb)


def content_hash(x: Column) -> Column:
    return F.sha2(F.coalesce(x, F.lit("")), 256)
