"""Functions for SQL users: temporary functions with SQL bodies, which the optimizer sees through, and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result type and body.
FUNCTIONS = [
    ("weft_n_words", "t STRING", "INT", r"regexp_count(t, '\\S+')"),
    ("weft_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 AND size(b) = 0 THEN 1.0D ELSE CAST(size(array_intersect(a, b)) AS DOUBLE) / greatest(size(array_union(a, b)), 1) END"),
    ("weft_edit_similarity", "a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END"),
    ("weft_hamming", "a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    ("weft_content_hash", "t STRING", "STRING", "sha2(coalesce(t, ''), 256)"),
    ("weft_host", "u STRING", "STRING", r"nullif(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"),
    ("weft_sentences", "t STRING", "ARRAY<STRING>", r"filter(split(t, '(?<=[.!?])\\s+'), s -> s <> '')"),
    ("weft_tokens", "t STRING", "ARRAY<STRING>", r"filter(split(regexp_replace(lower(t), '[^a-z0-9_\\s]', ' '), '\\s+'), w -> length(w) > 1)"),
]


def register(spark: SparkSession) -> list[str]:
    """Register all of them in a session and return their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION weft_text_chunks(t STRING, most INT) RETURNS TABLE(pos INT, chunk STRING)
RETURN SELECT pos, substring(t, pos * most + 1, most) FROM (SELECT explode(sequence(0, greatest(0, CAST(ceil(length(t) / most) AS INT) - 1))) AS pos)""")
    return [name for name, *_ in FUNCTIONS] + ["weft_text_chunks"]
