"""llms.txt of a site from its pages: title, summary, sections of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html, urls


def llms_txt(pages: DataFrame, per_section: int = 25) -> DataFrame:
    """host and its text; a link's label is its title if no other page of the host has it, else its path as words."""
    rows = pages.select(urls.host(F.col("url")).alias("host"), "url", urls.path(F.col("url")).alias("path"), html.title(F.col("html")).alias("title"), html.description(F.col("html")).alias("description"))
    rows = rows.withColumn("same", F.count("*").over(W.partitionBy("host", "title")))
    label = F.when((F.col("title") != "") & (F.col("same") == 1), F.col("title")).otherwise(urls.humanize(F.col("url")))
    rows = rows.select("host", "url", html.site_section(F.col("path")).alias("section"), label.alias("label"), "description", (F.col("path") == "/").alias("home"), "title")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("host", "section").orderBy("url"))).where(F.col("nth") <= per_section)
    line = F.concat(F.lit("- ["), F.col("label"), F.lit("]("), F.col("url"), F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(": "), F.col("description"))).otherwise(""))
    sections = rows.groupBy("host", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    heads = rows.groupBy("host").agg(F.max(F.when(F.col("home"), F.col("title"))).alias("title"), F.max(F.when(F.col("home"), F.col("description"))).alias("about"))
    body = sections.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: F.concat(F.lit("## "), F.initcap(s["section"]), F.lit("\n\n"), s["body"])), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), "host"), F.when(F.coalesce("about", F.lit("")) != "", F.concat(F.lit("\n\n> "), "about")).otherwise(""))
    return heads.join(body, "host").select("host", F.concat(head, F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
