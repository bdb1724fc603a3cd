"""Claims, conflicts, consensus and credibility over documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls as U
from ..sources.tables import SEARCH_SQL, search_rows, spread, table
from .corpus import SENTENCES

Q: dict[str, tuple] = {}


def claims(s: SparkSession, d: str) -> DataFrame:
    """Every sentence of each document with source, credibility and the key of its first three keywords."""
    docs = spread(table(s, d, "documents")).join(table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    rows = docs.select("doc_id", "source", F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias("credibility"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "claim"))
    return rows.withColumn("key", F.array_join(F.array_sort(F.slice(T.tokens(F.col("claim"), 3), 1, 3)), "_"))


_CLAIMS = rf"""cl as (select doc_id, source, credibility, generate_subscripts(s, 1) - 1 as pos, unnest(s) as claim from (select d.doc_id, source, case when q = 1 then 0.8::double when q = 0 then 0.3::double else 0.5::double end as credibility, {SENTENCES} as s from documents d left join (select doc_id, max(quality) as q from labels group by doc_id) l on d.doc_id = l.doc_id)),
ck as (select *, array_to_string(list_sort((list_filter(string_split_regex(regexp_replace(lower(claim), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3))[1:3]), '_') as key from cl)"""


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n_claims"), F.count_distinct("source").alias("n_sources"), F.round(F.avg("credibility"), 6).alias("avg_credibility"))


Q["claim_groups"] = (lambda s, d: groups(claims(s, d)), f"with {_CLAIMS} select key, count(*) as n_claims, count(distinct source) as n_sources, round(avg(credibility), 6) as avg_credibility from ck group by key")
Q["consensus"] = (
    lambda s, d: groups(claims(s, d)).where("n_sources >= 2 and avg_credibility >= 0.6").withColumn("strength", F.round(0.4 * F.col("n_sources") + 0.6 * F.col("avg_credibility"), 6)),
    f"with {_CLAIMS} select key, count(*) as n_claims, count(distinct source) as n_sources, round(avg(credibility), 6) as avg_credibility, round(0.4::double * count(distinct source) + 0.6::double * round(avg(credibility), 6), 6) as strength from ck group by key having count(distinct source) >= 2 and round(avg(credibility), 6) >= 0.6",
)
Q["research_gaps"] = (
    lambda s, d: groups(claims(s, d)).where("n_claims < 2 or avg_credibility < 0.5").agg(F.count("*").alias("n_gaps"), F.sum("n_claims").alias("n_claims")),
    f"with {_CLAIMS}, g as (select key, count(*) as n, round(avg(credibility), 6) as c from ck group by key) select count(*) as n_gaps, sum(n)::bigint as n_claims from g where n < 2 or c < 0.5",
)


def conflicts(rows: DataFrame) -> DataFrame:
    """For each group: pairs of claims of which one holds a word and the other its opposite, counted by signature.

    Claims are reduced to which of the twelve words they contain, so a group of any size becomes at most 4096
    signatures with counts, and pairs are counts multiplied: copies are never paired one by one.
    """
    low = F.lower("claim")
    mask = F.lit(0)
    for i, (neg, pos) in enumerate(L.ANTONYMS):
        mask = mask + F.when(F.contains(low, F.lit(neg)), 1 << (2 * i)).otherwise(0) + F.when(F.contains(low, F.lit(pos)), 2 << (2 * i)).otherwise(0)
    kinds = rows.where(F.col("key") != "").groupBy("key", mask.alias("m")).agg(F.count("*").alias("n"))
    a, b = kinds.alias("a"), kinds.alias("b")
    clash = F.lit(False)
    for i in range(len(L.ANTONYMS)):
        neg, pos = 1 << (2 * i), 2 << (2 * i)
        has = lambda c, bit: F.col(c).bitwiseAND(bit) > 0
        clash = clash | (has("a.m", neg) & has("b.m", pos)) | (has("a.m", pos) & has("b.m", neg))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.m") <= F.col("b.m"))).where(clash)
    n = F.when(F.col("a.m") == F.col("b.m"), (F.col("a.n") * (F.col("a.n") - 1) / 2).cast("long")).otherwise(F.col("a.n") * F.col("b.n"))
    return pairs.groupBy(F.col("a.key").alias("key")).agg(F.sum(n).alias("n_conflicts")).where("n_conflicts > 0")


_BITS = " + ".join(f"(case when contains(l, '{n}') then {1 << (2 * i)} else 0 end) + (case when contains(l, '{p}') then {2 << (2 * i)} else 0 end)" for i, (n, p) in enumerate(L.ANTONYMS))
_CLASH = " or ".join(f"((a.m & {1 << (2 * i)}) > 0 and (b.m & {2 << (2 * i)}) > 0) or ((a.m & {2 << (2 * i)}) > 0 and (b.m & {1 << (2 * i)}) > 0)" for i in range(len(L.ANTONYMS)))
Q["claim_conflicts"] = (
    lambda s, d: conflicts(claims(s, d)),
    f"""with {_CLAIMS}, k as (select key, {_BITS} as m, count(*) as n from (select key, lower(claim) as l from ck where key <> '') group by all)
select a.key, sum(case when a.m = b.m then a.n * (a.n - 1) // 2 else a.n * b.n end)::bigint as n_conflicts from k a join k b on a.key = b.key and a.m <= b.m where {_CLASH} group by a.key having n_conflicts > 0""",
)

#: Shares of the factors of credibility.
FACTORS = {"domain": 0.3, "content": 0.25, "kind": 0.2, "recency": 0.1, "indicators": 0.1, "citations": 0.05}
TOPIC = "the study of systems"


def _has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def credibility_factors(title: Column, content: Column, link: Column, author: Column | None = None, doi: Column | None = None, structured: Column | None = None, citations: Column | None = None) -> dict[str, Column]:
    """The six factors of a source's credibility from its whole text and link; what is not known of it adds nothing.

    Recency has no input and is neutral.
    """
    add = lambda test, by: F.when(F.lit(False) if test is None else F.coalesce(test, F.lit(False)), by).otherwise(0.0)
    given = lambda c: None if c is None else c.isNotNull() & (c != "")
    host, low, head = U.host(link), F.lower(content), F.lower(title)
    domain = F.when(host.isNull(), 0.3).when(_has(host, "edu", "gov"), 0.9).when(_has(host, "org"), 0.7).otherwise(0.5)
    quality = F.least(F.lit(1.0), 0.5 + add(T.n_words(content) > 500, 0.2) + add(T.research_readability(content) > 0.6, 0.1) + add(given(author), 0.1) + add(structured, 0.1))
    kind = F.when(_has(low, "abstract", "methodology"), 0.9).when(_has(head, "research", "study"), 0.8).when(_has(low, "peer reviewed"), 0.9).when(_has(head, "news", "blog"), 0.4).otherwise(0.6)
    indicators = F.least(F.lit(1.0), 0.5 + add(_has(low, "citation", "reference"), 0.2) + add(_has(low, "doi:"), 0.2) + add(given(author), 0.1))
    potential = F.least(F.lit(1.0), 0.5 + add(given(doi), 0.3) + add(citations, 0.2))
    return {"domain": domain, "content": quality, "kind": kind, "recency": F.lit(0.6), "indicators": indicators, "citations": potential}


def traditional_relevance(content: Column, topic: str) -> Column:
    """0.4 of the density and 0.6 of the coverage of the topic's words over two letters, held to 0..1."""
    words = [w for w in re.split(r"\s+", topic.lower()) if len(w) > 2]
    if not words:
        return F.lit(0.5)
    hits = F.lit(0)
    for w in words:
        hits = hits + F.regexp_count(F.lower(content), F.lit(rf"{T.EDGE}{re.escape(w)}{T.EDGE}"))
    score = T.let(hits, lambda h: h / F.greatest(T.n_spaced(content), F.lit(1)) * 0.4 + h / len(words) * 0.6)
    return F.when(content.isNull() | (content == ""), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _credibility(s: SparkSession, d: str) -> DataFrame:
    rows = search_rows(spread(table(s, d, "documents")))
    host, snip = U.host(F.col("link")), F.lower("snippet")
    site = F.when(F.contains(host, F.lit("edu")), 0.3).when(F.contains(host, F.lit("gov")), 0.4).when(F.contains(host, F.lit("org")), 0.2).otherwise(0.0)
    first = F.least(F.lit(1.0), 0.5 + site + F.when(F.contains(snip, F.lit("research")) | F.contains(snip, F.lit("study")), 0.1).otherwise(0.0) + F.when(F.contains(snip, F.lit("peer reviewed")), 0.2).otherwise(0.0))
    kind = F.when(host.endswith(".gov"), "government").when(host.endswith(".edu") | F.contains(host, F.lit("scholar.")), "academic").when(host.endswith("wikipedia.org"), "wiki")
    for h in L.BLOG_HOSTS:
        kind = kind.when(host.endswith(h), "blog")
    for h in L.NEWS_HOSTS:
        kind = kind.when(host.endswith(h), "news")
    kind = kind.when(F.contains(host, F.lit("news")), "news").when(host.endswith(".com") | host.endswith(".io") | host.endswith(".co"), "commercial")
    relevance = F.least(F.lit(1.0), 0.5 + F.when(F.contains(F.lower("title"), F.lit("the")), 0.3).otherwise(0.0) + F.when(F.contains(snip, F.lit("the")), 0.2).otherwise(0.0))
    factors = credibility_factors(F.col("title"), F.col("snippet"), F.col("link"))
    overall = F.least(F.lit(1.0), sum((c * FACTORS[k] for k, c in factors.items()), F.lit(0.0)))
    rows = rows.select("doc_id", F.round(first, 6).alias("initial"), overall.alias("o"), kind.alias("kind"), relevance.alias("r"), F.round(traditional_relevance(F.col("snippet"), TOPIC), 6).alias("topic"))
    return rows.select("doc_id", "initial", F.round("o", 6).alias("overall"), "kind", F.round("r", 6).alias("relevance"), F.round(F.col("o") * (0.4 + 0.6 * F.col("r")), 6).alias("verified"), "topic")


_REL = "least(1, 0.5::double + case when contains(lower(title), 'the') then 0.3::double else 0::double end + case when contains(lower(snippet), 'the') then 0.2::double else 0::double end)"
_W = r"len(list_filter(string_split_regex(snippet, '\s+'), lambda w: w <> ''))"
_OVERALL = f"""(case when contains(host, 'edu') or contains(host, 'gov') then 0.9::double when contains(host, 'org') then 0.7::double else 0.5::double end * 0.3::double
  + least(1, 0.5::double + case when {_W} > 500 then 0.2::double else 0::double end + case when len(string_split(snippet, ' ')) / len(string_split_regex(snippet, '[.!?]')) < 15 then 0.1::double else 0::double end) * 0.25::double
  + case when contains(low, 'abstract') or contains(low, 'methodology') then 0.9::double when contains(lower(title), 'research') or contains(lower(title), 'study') then 0.8::double when contains(low, 'peer reviewed') then 0.9::double when contains(lower(title), 'news') or contains(lower(title), 'blog') then 0.4::double else 0.6::double end * 0.2::double
  + 0.6::double * 0.1::double + least(1, 0.5::double + case when contains(low, 'citation') or contains(low, 'reference') then 0.2::double else 0::double end + case when contains(low, 'doi:') then 0.2::double else 0::double end) * 0.1::double + 0.5::double * 0.05::double)"""
_HITS = "(" + " + ".join(rf"len(regexp_extract_all(low, '\b{w}\b'))" for w in ("the", "study", "systems")) + ")"
Q["credibility"] = (
    _credibility,
    "with " + SEARCH_SQL + f""", h as (select *, lower(snippet) as low, split_part(split_part(link, '//', 2), '/', 1) as host from rows), s as (select *, {_OVERALL} as o, {_REL} as r, {_HITS} as hits from h)
select doc_id, round(least(1, 0.5::double + case when contains(host, 'edu') then 0.3::double when contains(host, 'gov') then 0.4::double when contains(host, 'org') then 0.2::double else 0::double end + case when contains(low, 'research') or contains(low, 'study') then 0.1::double else 0::double end + case when contains(low, 'peer reviewed') then 0.2::double else 0::double end), 6) as initial,
  round(o, 6) as overall, case when host like '%.gov' then 'government' when host like '%.edu' then 'academic' when host like '%.com' then 'commercial' end as kind, round(r, 6) as relevance, round(o * (0.4::double + 0.6::double * r), 6) as verified,
  round(case when snippet = '' then 0.5::double else greatest(0, least(1, hits / len(string_split_regex(snippet, '\\s+')) * 0.4::double + hits / 3 * 0.6::double)) end, 6) as topic from s""",
)
Q["source_types"] = (
    lambda s, d: _credibility(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("avg_overall"), F.count_if(F.col("initial") >= 0.7).alias("high"), F.count_if((F.col("initial") < 0.7) & (F.col("initial") >= 0.4)).alias("medium")),
    f"select kind, count(*) as n, round(avg(overall), 6) as avg_overall, count(*) filter (where initial >= 0.7) as high, count(*) filter (where initial < 0.7 and initial >= 0.4) as medium from ({Q['credibility'][1]}) group by kind",
)
