"""Search over rows with title, snippet and link: BM25, term-vector, authority and freshness scores, final rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls
from .ranks import with_rank

WEIGHTS = {"bm25": 0.4, "semantic": 0.3, "authority": 0.2, "freshness": 0.1}


def renormalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights scaled to sum to one, missing ones taken from the defaults."""
    merged = {**WEIGHTS, **weights}
    whole = sum(merged.values())
    return {k: v / whole for k, v in merged.items()}


def query_terms(query: str) -> list[str]:
    """Tokens of a query as the token columns have them, repeats included."""
    import re

    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9_\s]", " ", query.lower())) if len(t) > 1]


def figures(content: Column, query: str, norm: bool = False) -> Column:
    """Struct of what ranking needs of one text: n (tokens), tf (of each distinct term), with ``norm`` that of its counts.

    Without the norm no token is made: the text is scanned for all its tokens and for those of the query.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    if norm:
        tf = lambda r, t: F.coalesce(F.get(F.filter(r, lambda x: x["term"] == F.lit(t)), F.lit(0))["n"], F.lit(0))
        count = lambda r: F.struct(F.aggregate(r, F.lit(0), lambda a, x: a + x["n"]).alias("n"), _ints([tf(r, t) for t in terms]).alias("tf"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x["n"].cast("double") * x["n"])).alias("norm"))
        return T.let(T.runs(T.tokens(content)), count)
    edge = "[a-z0-9_]"
    found = F.regexp_extract_all(F.lower(content), F.lit(rf"(?<!{edge})(?:{'|'.join(terms)})(?!{edge})"), F.lit(0)) if terms else F.array().cast("array<string>")
    tf = T.let(found, lambda hits: _ints([_count(hits, t) for t in terms]))
    return F.struct(F.regexp_count(F.lower(content), F.lit(f"{edge}{{2,}}")).alias("n"), tf.alias("tf"))


def _count(items: Column, value: str) -> Column:
    return F.size(F.filter(items, lambda x: x == F.lit(value)))


def _ints(values: list[Column]) -> Column:
    return F.array(*values) if values else F.array().cast("array<int>")


def with_bm25(rows: DataFrame, query: str, content: str = "content", figure: str | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Columns bm25_raw and bm25 (held to 0..1): the mean over the query's terms of idf times saturated frequency.

    The idf has no added one, so a term in more than half of the rows counts against a row.  Corpus figures are one
    aggregation over the ``figures`` of each row, and no token leaves its row.
    """
    terms = query_terms(query)
    if not terms:
        return rows.withColumns({"bm25_raw": F.lit(0.0), "bm25": F.lit(0.0)})
    distinct, own = list(dict.fromkeys(terms)), figure or "__figures"
    if figure is None:
        rows = rows.withColumn(own, figures(F.col(content), query))
    n, tf = F.col(own)["n"], F.col(own)["tf"]
    stats = rows.select(n.alias("n"), tf.alias("tf")).agg(F.count("*").alias("rows"), F.avg("n").alias("avg"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct)))).first()
    avg, raw = stats["avg"] or 1.0, F.lit(0.0)
    for t in terms:
        i = distinct.index(t)
        df = stats[f"df{i}"] or 0
        idf = F.log((F.lit(float(stats["rows"])) - df + 0.5) / (F.lit(float(df)) + 0.5))
        raw = raw + F.when(tf[i] > 0, idf * (tf[i] * (k1 + 1) / (tf[i] + k1 * (1 - b + b * (n / F.lit(float(avg))))))).otherwise(0.0)
    rows = rows.withColumn("bm25_raw", raw / len(terms)).withColumn("bm25", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bm25_raw"))))
    return rows if figure else rows.drop(own)


def semantic(figure: Column, content: Column, query: str) -> Column:
    """Cosine of term counts, 0.2 more where the query stands in the text, one at most."""
    terms = query_terms(query)
    count = {t: terms.count(t) for t in dict.fromkeys(terms)}
    norm_q = sum(c * c for c in count.values()) ** 0.5
    dot = F.lit(0.0)
    for i, c in enumerate(count.values()):
        dot = dot + c * figure["tf"][i]
    cosine = F.when((figure["norm"] > 0) & F.lit(norm_q > 0), dot / (figure["norm"] * F.lit(norm_q or 1.0))).otherwise(0.0)
    return F.least(F.lit(1.0), cosine + F.when(F.contains(content, F.lit(query.lower())), 0.2).otherwise(0.0))


def domain_authority(host: Column) -> Column:
    """Listed host, else 0.8 of its listed parent, else by ending, else 0.3."""
    parent = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    deep = F.size(F.split(host, r"\.")) > 2
    out = None
    for name, v in L.AUTHORITY.items():
        out = F.when(host == name, v) if out is None else out.when(host == name, v)
    for name, v in L.AUTHORITY.items():
        out = out.when(deep & (parent == name), v * 0.8)
    for end, v in L.AUTHORITY_BY_ENDING.items():
        out = out.when(host.endswith(end), v)
    return out.otherwise(0.3)


def authority(link: Column, https: float = 0.1, per_segment: float = 0.02) -> Column:
    host, segs = urls.host(link), F.size(urls.segments(link))
    score = domain_authority(host) * 0.6 + F.when(urls.scheme(link) == "https", https).otherwise(0.0) - F.least(F.lit(0.3), segs * per_segment)
    score = score + F.when((urls.query(link) == "") & (segs <= 3), 0.1).otherwise(0.0)
    score = score - F.when((F.size(F.split(host, r"\.")) > 2) & ~host.startswith("www."), 0.1).otherwise(0.0)
    return F.when(urls.is_valid(link), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.1)


def freshness(published: Column, as_of: Column, max_months: float = 24, decay: float = 0.1) -> Column:
    """0.5 for no date, 1 for a future one, 0 beyond ``max_months``, else exponential decay; a month has 30.44 days."""
    months = (F.unix_timestamp(as_of) - F.unix_timestamp(published)) / (86400 * 30.44)
    return F.when(published.isNull(), 0.5).when(months < 0, 1.0).when(months > max_months, 0.0).otherwise(F.exp(-decay * months))


def rank_results(rows: DataFrame, query: str, order: str = "doc_id", weights: dict[str, float] | None = None, published: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """Scores and rank of rows (title, snippet, link); equals keep the order of ``order``."""
    w = {**WEIGHTS, **(weights or {})}
    content = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    rows = with_bm25(rows.withColumn("__f", figures(content, query, norm=True)), query, figure="__f")
    fresh = freshness(published, as_of) if published is not None else F.lit(0.5)
    rows = rows.withColumns({"semantic": semantic(F.col("__f"), content, query), "authority": authority(F.col("link")), "freshness": fresh}).drop("__f")
    rows = rows.withColumn("final", sum((F.col(k) * v for k, v in w.items()), F.lit(0.0)))
    return with_rank(rows.withColumn("__s", F.round("final", 9)), [F.col("__s").desc(), F.col(order)]).drop("__s")
