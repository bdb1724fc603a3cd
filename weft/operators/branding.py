"""Colours and fonts of sites from their style sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html


def css(pages: DataFrame) -> DataFrame:
    """page_id, name, value of the declarations in style elements and attributes, in order."""
    blocks = F.concat(F.regexp_extract_all("html", F.lit(r"(?is)<style\b[^>]*>(.*?)</style\s*>"), F.lit(1)), F.regexp_extract_all("html", F.lit(r"""(?is)\sstyle\s*=\s*"([^"]*)\""""), F.lit(1)))
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(F.array_join(blocks, ";"), F.lit(r"(?is)([\w-]+\s*:\s*[^;{}]+)"), F.lit(1))).alias("pos", "d")).select("page_id", "pos", F.lower(F.trim(F.substring_index("d", ":", 1))).alias("name"), F.trim(F.expr("substr(d, instr(d, ':') + 1)")).alias("value"))


def colors(pages: DataFrame, most: int = 24) -> DataFrame:
    """page_id, color, n, source and rank: variables first, then the theme colour, then declarations; then by frequency."""
    found = css(pages).select("page_id", F.explode(F.regexp_extract_all("value", F.lit(r"(#[0-9A-Fa-f]{3,8}\b|rgba?\([^)]*\))"), F.lit(1))).alias("raw"), F.when(F.col("name").startswith("--"), 0).otherwise(2).alias("s"))
    theme = pages.select("page_id", html.meta(F.col("html"), "theme-color").alias("raw"), F.lit(1).alias("s"))
    rows = found.unionByName(theme).withColumn("color", html.color(F.col("raw"))).where("color is not null").groupBy("page_id", "color").agg(F.count("*").alias("n"), F.min("s").alias("s"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("s", F.col("n").desc(), "color"))).where(F.col("rank") <= most)
    return rows.select("page_id", "color", "n", F.when(F.col("s") == 0, "css-var").when(F.col("s") == 1, "theme-color").otherwise("declaration").alias("source"), "rank")


def fonts(pages: DataFrame, most: int = 12) -> DataFrame:
    first = F.trim(F.regexp_replace(F.substring_index("value", ",", 1), "[\"']", ""))
    rows = css(pages).where("name in ('font-family', 'font')").select("page_id", first.alias("font")).where("font <> ''").groupBy("page_id", "font").agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.col("n").desc(), "font"))).where(F.col("rank") <= most)


def variables(pages: DataFrame) -> DataFrame:
    """page_id, name and value of each style variable, the first definition of each."""
    rows = css(pages).where("name like '--%'")
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "name").orderBy("pos"))).where("nth = 1").select("page_id", "name", "value")
