"""Sitemaps, feeds, robots files and search-result items as DataFrames of strings."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U

#: Places where sitemaps are looked for.
COMMON_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/sitemap.xml.gz", "/sitemap.txt", "/news-sitemap.xml", "/wp-sitemap.xml"]


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), F.lit(0))


def _inner(block: Column, tag: str) -> Column:
    raw = F.regexp_extract(block, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(H.decoded(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))), F.lit(""))


def sitemap_entries(files: DataFrame, most: int = 50_000) -> DataFrame:
    """url, pos, loc, lastmod, changefreq, priority of <url> entries, RSS items and Atom entries; at most ``most`` a file."""
    x = F.col("xml")
    url = F.transform(_blocks(x, "url"), lambda b: F.struct(_inner(b, "loc").alias("loc"), _inner(b, "lastmod").alias("lastmod"), _inner(b, "changefreq").alias("changefreq"), _inner(b, "priority").alias("priority")))
    item = F.transform(_blocks(x, "item"), lambda b: F.struct(_inner(b, "link").alias("loc"), _inner(b, "pubDate").alias("lastmod"), F.lit("weekly").alias("changefreq"), F.lit("0.5").alias("priority")))
    entry = F.transform(_blocks(x, "entry"), lambda b: F.struct(F.nullif(H.attribute(F.regexp_extract(b, r"(?is)<link\b[^>]*>", 0), "href"), F.lit("")).alias("loc"), _inner(b, "updated").alias("lastmod"), F.lit("weekly").alias("changefreq"), F.lit("0.5").alias("priority")))
    rows = files.select("url", F.posexplode(F.slice(F.concat(url, item, entry), 1, most)).alias("pos", "e")).select("url", "pos", "e.*").where("loc is not null")
    return rows.withColumn("loc", U.normalize_or_same(F.col("loc")))


def sitemap_children(files: DataFrame, most: int = 50) -> DataFrame:
    return files.select(F.col("url").alias("parent"), F.explode(F.slice(F.transform(_blocks(F.col("xml"), "sitemap"), lambda b: _inner(b, "loc")), 1, most)).alias("url")).where("url is not null")


def sitemap_closure(files: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Entries of the root sitemaps and of those their indexes name, to ``depth`` levels; ``files`` holds (url, xml)."""
    seen = front = roots.select("url").distinct()
    for _ in range(depth):
        front = sitemap_children(files.join(front, "url", "left_semi")).select("url").distinct().join(seen, "url", "left_anti")
        seen = seen.unionByName(front)
    return sitemap_entries(files.join(seen, "url", "left_semi"))


def sitemap_filter(entries: DataFrame, domain: str | None = None, path: str | None = None, changefreq: str | None = None, priority: tuple[float, float] | None = None, since: str | None = None) -> DataFrame:
    """A missing priority counts as 0.5; a missing or unreadable date passes."""
    if domain:
        entries = entries.where(F.contains(U.host(F.col("loc")), F.lit(domain)))
    if path:
        entries = entries.where(U.path(F.col("loc")).rlike(f"(?i){path}"))
    if changefreq:
        entries = entries.where(F.col("changefreq") == changefreq)
    if priority:
        entries = entries.where(F.coalesce(F.col("priority").try_cast("double"), F.lit(0.5)).between(*priority))
    if since:
        entries = entries.where(F.coalesce(F.col("lastmod").try_cast("timestamp") >= F.lit(since).cast("timestamp"), F.lit(True)))
    return entries


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """host and sitemap URL: those that robots files name and the common places."""
    named = robots.select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap"))
    common = robots.select("host", F.explode(F.array(*(F.concat(F.lit("https://"), F.col("host"), F.lit(p)) for p in COMMON_SITEMAPS))).alias("sitemap"))
    return named.unionByName(common).distinct()


def robots_sections(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host and the lines of the group for an agent: its own, else that of all agents; agents named in a row share a group."""
    line = F.trim(F.regexp_replace(F.col("line"), r"\s*#.*$", ""))
    lines = robots.select("host", F.posexplode(F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n")).alias("pos", "line")).select("host", "pos", line.alias("line")).where("line <> ''")
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.expr("substr(line, instr(line, ':') + 1)"))
    rows = lines.select("host", "pos", key.alias("key"), value.alias("value"))
    w = W.partitionBy("host").orderBy("pos")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("section", F.sum("opens").over(w))
    own = rows.where("key = 'user-agent'").select("host", "section", F.when(F.lower("value") == agent.lower(), 1).when(F.col("value") == "*", 0).alias("fit")).where("fit is not null")
    best = own.groupBy("host").agg(F.max("fit").alias("best"))
    chosen = own.join(best, "host").where("fit = best").select("host", "section").distinct()
    return rows.where("key <> 'user-agent'").join(chosen, ["host", "section"]).select("host", "key", "value")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, allow, prefix and pattern of the rules for an agent; * stands for anything and a final $ for the end of the path."""
    rows = robots_sections(robots, agent).where("key in ('allow', 'disallow') and value <> ''")
    quoted = F.regexp_replace("value", r"([\\.+?()\[\]{}|^])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    return rows.select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("prefix"), pattern.alias("pattern"))


def crawl_delays(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host and seconds between two requests, where its robots file asks for them."""
    return robots_sections(robots, agent).where("key = 'crawl-delay'").groupBy("host").agg(F.max(F.col("value").try_cast("double")).alias("delay"))


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """url and allowed: the longest matching rule decides, allow before disallow; no robots file or rule allows."""
    rows = urls.select("url", U.host(F.col("url")).alias("host"), F.concat(U.path(F.col("url")), F.when(U.query(F.col("url")) != "", F.concat(F.lit("?"), U.query(F.col("url")))).otherwise("")).alias("path"))
    hits = rows.join(robots_rules(robots, agent), "host").where(F.expr("path rlike pattern"))
    best = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return rows.join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


def sitemap_media(files: DataFrame) -> DataFrame:
    """loc, kind (image, video, news), address, title and date of what the <url> entries of sitemaps carry."""
    def entries(block: Column, kind: str, tag: str, address: str, date: str) -> Column:
        return F.transform(_blocks(block, tag), lambda b: F.struct(F.lit(kind).alias("kind"), _inner(b, address).alias("address"), _inner(b, f"{tag.split(':')[0]}:title").alias("title"), _inner(b, date).alias("date")))

    every = lambda b: F.concat(entries(b, "image", "image:image", "image:loc", "image:date"), entries(b, "video", "video:video", "video:content_loc", "video:publication_date"), entries(b, "news", "news:news", "news:name", "news:publication_date"))
    rows = files.select("url", F.explode(F.transform(_blocks(F.col("xml"), "url"), lambda b: F.struct(_inner(b, "loc").alias("loc"), every(b).alias("m")))).alias("e"))
    return rows.select("url", F.col("e.loc").alias("loc"), F.explode("e.m").alias("m")).select("url", "loc", "m.*")


def unpacked(files: DataFrame) -> DataFrame:
    """url and xml of sitemap files read as bytes (url, content), those that are gzip packed included; bad ones give null."""
    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    data = gzip.decompress(data) if data and data[:2] == b"\x1f\x8b" else data
                    out.append(None if data is None else data.decode("utf-8", "replace"))
                except (OSError, EOFError, zlib.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["url", "xml"])

    return files.select("url", "content").mapInArrow(run, "url string, xml string")


def serp_positions(items: DataFrame, target: str) -> DataFrame:
    """keyword, best and all positions of a domain among organic items; missing ranks last."""
    bare = U.bare_domain(F.lit(target))
    hits = items.where("type = 'organic'").withColumn("hit", U.domain_matches(U.bare_domain(F.coalesce("domain", F.lit(""))), bare))
    return hits.groupBy("keyword").agg(F.min(F.when(F.col("hit"), F.col("rank_group"))).alias("best"), F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("rank_group")))).alias("positions"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each url."""
    return snapshots.withColumn("nth", F.row_number().over(W.partitionBy("url").orderBy(F.col("ts").desc()))).where("nth = 1").drop("nth")
