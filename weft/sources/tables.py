"""Parquet tables and frames derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html, text, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer splits than cores; a large table has more and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, src, dst, text, rel, is_external: the first anchor for each absolute reference of a page.

    A page's anchors are told apart inside its row; pages do not move.
    """
    rows = pages.select("page_id", F.col("url").alias("src"), urls.base_parts(html.base(F.col("html"), F.col("url"))).alias("base"), html.anchors(F.col("html")).alias("found"))
    whole = F.transform("found", lambda a, i: F.struct(i.alias("pos"), urls.resolve(a["href"], None, F.col("base")).alias("dst"), a["text"].alias("text"), a["rel"].alias("rel")))
    rows = rows.select("page_id", "src", urls.origin(F.col("src")).alias("origin"), whole.alias("a"))
    first = F.filter("a", lambda x, i: F.array_position(F.col("a")["dst"], x["dst"]) == i + 1)
    rows = rows.select("page_id", "src", "origin", F.explode_outer(first).alias("a")).where("a is not null")
    return rows.select("page_id", F.col("a.pos").alias("pos"), "src", F.col("a.dst").alias("dst"), F.col("a.text").alias("text"), F.col("a.rel").alias("rel"), (urls.origin(F.col("a.dst")) != F.col("origin")).alias("is_external"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: trade between nations as a link graph, all of it."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("weight"))


EDGES_SQL = """
edges as (
  select s_nationkey as src, c_nationkey as dst, count(*) as weight
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where s_nationkey <> c_nationkey group by all)
"""


def site_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: every page under the folders of its path, folder to folder down to the page, and a link from the page home."""
    p = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.segments(F.col("url")).alias("s")).where("host is not null")
    node = lambda n: F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("s", F.lit(1), n), "/"))
    down = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(node(i - 1).alias("src"), node(i).alias("dst")))
    home = F.array(F.struct(node(F.size("s")).alias("src"), node(F.lit(0)).alias("dst")))
    return p.where(F.size("s") > 0).select(F.explode(F.concat(down, home)).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("weight"))


SITE_SQL = r"""
sp as (select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as s from pages),
edges as (
  select src, dst, count(*) as weight from (
    select host || '/' || array_to_string(s[1:i - 1], '/') as src, host || '/' || array_to_string(s[1:i], '/') as dst from sp, unnest(range(1, len(s) + 1)) t(i)
    union all select host || '/' || array_to_string(s, '/'), host || '/' from sp where len(s) > 0) group by all)
"""


def versions(pages: DataFrame) -> DataFrame:
    """page_id, url, old, new: each page and a later version of it, edited by page_id in a fixed way."""
    old = F.col("html")
    changed = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(old, r"(?s)<h1>.*?</h1>", "<h1>Changed heading</h1>")).otherwise(old)
    added = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(changed, "</article>", "<section>Added section</section></article>")).otherwise(changed)
    return pages.select("page_id", "url", old.alias("old"), added.alias("new"))


def search_link(source: Column, doc_id: Column) -> Column:
    """A link made of a source and a document's number."""
    host = F.concat(source, F.when(doc_id % 4 == 0, ".edu").when(doc_id % 4 == 1, ".org").when(doc_id % 4 == 2, ".com").otherwise(".gov"))
    return F.concat(F.when(doc_id % 2 == 0, "https://").otherwise("http://"), host, F.lit("/doc/"), doc_id.cast("string"))


def search_rows(documents: DataFrame) -> DataFrame:
    """doc_id, title, snippet, link: documents as search results, their first sentence as title and their whole text as snippet."""
    body = F.col("text")
    first = F.regexp_extract(body, r"(?s)^(.*?)(?:(?<=[.!?])\s|\z)", 1)
    return documents.select("doc_id", F.coalesce(first, F.lit("")).alias("title"), body.alias("snippet"), search_link(F.col("source"), F.col("doc_id")).alias("link"))


SEARCH_SQL = r"""
rows as (
  select doc_id, coalesce(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')[1], '') as title, text as snippet,
    (case when doc_id % 2 = 0 then 'https://' else 'http://' end) || source || (case doc_id % 4 when 0 then '.edu' when 1 then '.org' when 2 then '.com' else '.gov' end) || '/doc/' || doc_id as link
  from documents)
"""


def eight_grams(rows: DataFrame, key: str) -> DataFrame:
    """key and digest of every distinct run of eight tokens of a text."""
    tokens = rows.select(key, text.tokens(F.col("text"), 0).alias("t")).where(F.size("t") >= 8)
    return tokens.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda i: F.md5(F.array_join(F.slice("t", i, 8), " "))))).alias("g"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the number of eight-token runs that a document shares with a benchmark item."""
    mine = eight_grams(spread(table(spark, sf_dir, "documents")), "doc_id")
    return mine.join(eight_grams(table(spark, sf_dir, "benchmark"), "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def result_lists(spark: SparkSession, sf_dir: str, most: int = 100) -> DataFrame:
    """query_id, position, doc_id, title, snippet, link: for each benchmark item a page of the documents that share most with it."""
    shared = benchmark_overlap(spark, sf_dir)
    best = W.partitionBy("item_id").orderBy(F.col("shared").desc(), "doc_id")
    listed = shared.withColumn("position", F.row_number().over(best)).where(F.col("position") <= most).select(F.col("item_id").alias("query_id"), "position", "doc_id")
    return listed.join(search_rows(table(spark, sf_dir, "documents")), "doc_id")


_GRAMS = r"""select {k}, g from (select {k}, list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) as l from (select {k}, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: w <> '') as t from {f})), unnest(l) u(g)"""
OVERLAP_SQL = f"select doc_id, item_id, count(*) as shared from ({_GRAMS.format(k='doc_id', f='documents')}) join ({_GRAMS.format(k='item_id', f='benchmark')}) using (g) group by all"
RESULT_LISTS_SQL = SEARCH_SQL + f""",
lists as (select item_id as query_id, position, doc_id, title, snippet, link from (select *, row_number() over (partition by item_id order by shared desc, doc_id) as position from ({OVERLAP_SQL})) join rows using (doc_id) where position <= 100)"""
