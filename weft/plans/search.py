"""Ranking queries: BM25 over documents, result ranking, authority, search rows, blocked duplicate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import dedup as D
from ..operators import ranking as R
from ..operators.lineage import cut
from ..operators.ranks import with_rank
from ..sources.tables import RESULT_LISTS_SQL, SEARCH_SQL, result_lists, search_link, search_rows, spread, table

QUERY = "that with this"
Q: dict[str, tuple] = {}


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents; those that score nothing are left out of the twenty, not searched for beforehand."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("content"))
    scored = R.with_bm25(d, QUERY).select("doc_id", F.round("bm25", 6).alias("score"), (F.col("bm25") > 0).alias("hit"))
    top = scored.orderBy(F.col("hit").desc(), F.col("score").desc(), "doc_id").limit(20).where("hit").drop("hit")
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "doc_id")))


_TOK = r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"
_BM25 = r"""
tok as (select doc_id, t, len(t) as n from (select doc_id, {tok} as t from {f})),
st as (select count(*)::double as n, avg(n) as a from tok),
q(term) as (values ('that'), ('with'), ('this')),
tf as (select doc_id, tok.n, term, len(list_filter(t, lambda x: x = term)) as tf from tok, q),
df as (select term, count(*) filter (where tf > 0)::double as df from tf group by term),
bm as (select doc_id, sum(case when tf > 0 then ln((st.n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * (tf.n / a)))) else 0 end) / 3 as raw
  from tf join df using (term), st group by doc_id)"""
Q["bm25_rank"] = (
    _bm25,
    "with " + _BM25.format(tok=_TOK.format(x="text"), f="documents") + """
select doc_id, score, row_number() over (order by score desc, doc_id)::int as rank from (select doc_id, round(greatest(0, least(1, raw)), 6) as score from bm where raw > 0) order by score desc, doc_id limit 20""",
)


def _rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.rank_results(search_rows(spread(table(spark, sf_dir, "documents"))), QUERY)
    rows = with_rank(rows, [F.col("doc_id")], "place")
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in ("bm25", "semantic", "authority", "freshness", "final")), "rank", (F.col("place") - F.col("rank")).alias("rank_change"))




_AUTH = """greatest(0, least(1, 0.6::double * (case when host like '%.edu' then 0.8::double when host like '%.gov' then 0.9::double when host like '%.org' then 0.6::double when host like '%.com' then 0.4::double else 0.3::double end)
  + case when link like 'https:%' then 0.1::double else 0::double end - least(0.3::double, segs * 0.02::double) + case when segs <= 3 then 0.1::double else 0::double end))"""
Q["result_rank"] = (
    _rank,
    "with " + SEARCH_SQL + ", c as (select *, lower(title || ' ' || snippet) as content, split_part(split_part(link, '//', 2), '/', 1) as host, 2 as segs from rows)," + _BM25.format(tok=_TOK.format(x="content"), f="c") + f""",
norms as (select doc_id, sqrt(sum(n * n)) as norm from (select doc_id, x, count(*) as n from (select doc_id, unnest(t) as x from tok) group by all) group by doc_id),
dots as (select doc_id, sum(tf)::double as d from tf group by doc_id),
s as (select doc_id, greatest(0, least(1, raw)) as bm25, least(1, case when norm > 0 then d / (norm * sqrt(3::double)) else 0 end + case when contains(content, 'that with this') then 0.2::double else 0::double end) as semantic,
  {_AUTH} as authority, 0.5::double as freshness from c join bm using (doc_id) join dots using (doc_id) left join norms using (doc_id)),
f as (select *, bm25 * 0.4::double + semantic * 0.3::double + authority * 0.2::double + freshness * 0.1::double as final from s),
r as (select *, row_number() over (order by round(final, 9) desc, doc_id) as rank from f)
select doc_id, round(bm25, 6) as bm25, round(semantic, 6) as semantic, round(authority, 6) as authority, round(freshness, 6) as freshness, round(final, 6) as final, rank, row_number() over (order by doc_id) - rank as rank_change from r""",
)


def _serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a target domain by keyword, with the best and their number: source as keyword, position by doc_id.

    Positions come from one rank over all rows less that of the keyword's first, so no task sorts a keyword.
    """
    docs = table(spark, sf_dir, "documents")
    rows = with_rank(docs.select("doc_id", "source", search_link(F.col("source"), F.col("doc_id")).alias("link")), [F.col("source"), F.col("doc_id")], "at")
    first = rows.groupBy("source").agg(F.min("at").alias("first"))
    hits = rows.where(urls.domain_matches(urls.host(F.col("link")), F.concat(F.col("source"), F.lit(".edu"))))
    best = hits.groupBy("source").agg(F.min("at").alias("best"), F.count("*").alias("hits"))
    placed = hits.join(F.broadcast(first.join(best, "source")), "source") if first.count() <= 100_000 else hits.join(first.join(best, "source"), "source")
    return placed.select("source", "hits", *((F.col(c) - F.col("first") + 1).alias(n) for c, n in (("best", "best"), ("at", "position"))))


Q["serp_rank"] = (
    _serp,
    "with " + SEARCH_SQL + """, p as (select source, link, row_number() over (partition by source order by doc_id) as position from rows join (select doc_id, source from documents) using (doc_id)),
h as (select *, split_part(split_part(link, '//', 2), '/', 1) = source || '.edu' as hit from p)
select source, count(*) over (partition by source) as hits, min(position) over (partition by source) as best, position from h where hit""",
)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lists(result_lists(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of results of one list that count as one."""
    return D.duplicate_pairs(_lists(spark, sf_dir)).select("query_id", "a", "b", *(F.round(c, 6).alias(c) for c in ("url", "title", "content", "combined")), "reason")


def _led(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(_lists(spark, sf_dir))
    pairs = cut(D.duplicate_pairs(rows))
    return rows, pairs, D.leaders(rows, pairs)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary of each group with what it took over."""
    rows, _, led = _led(spark, sf_dir)
    out = D.merged(rows, led)
    return out.select("query_id", "doc_id", "link", "duplicates", *(F.size(f"other_{c}").alias(f"n_{c}") for c in ("titles", "snippets", "links")), F.md5(F.array_join(F.array_sort("other_links"), " ")).alias("links_md5"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pairs, led = _led(spark, sf_dir)
    return D.statistics(rows, led, pairs)


_FNV = "list_reduce(list_prepend({basis}::bigint, list_transform(string_split(tk, ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_LISTS = RESULT_LISTS_SQL + rf""",
dd as (select distinct doc_id, lower(snippet) as c from lists),
tk as (select doc_id, tk, count(*) as n from (select doc_id, unnest(string_split_regex(c, '\s+')) as tk from dd) group by all),
fv as (select doc_id, n, case when tk = '' then {0x811C9DC5} else {_FNV.format(basis=0x811C9DC5)} end as lo, case when tk = '' then {0x84222325} else {_FNV.format(basis=0x84222325)} end as hi from tk),
hb as (select doc_id, list_transform(range(64), lambda b: 0) as z, [{', '.join(f"sum(n * (2 * ((case when {b} < 32 then lo else hi end >> {b % 32}) & 1) - 1)) > 0" for b in range(64))}] as h from fv group by doc_id),
ls as (select l.*, h.h as h, lower(trim(title)) as t, list_distinct(list_filter(string_split_regex(regexp_replace(lower(trim(title)), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)) as tt, length(snippet) as n from lists l join hb h using (doc_id)),
pr as (select a.query_id, a.doc_id as a, b.doc_id as b, 1 - levenshtein(a.link, b.link) / greatest(length(a.link), length(b.link)) as url,
  case when a.t = '' or b.t = '' then 0 when a.t = b.t then 1 else 0.7::double * len(list_intersect(a.tt, b.tt)) / greatest(1, len(a.tt) + len(b.tt) - len(list_intersect(a.tt, b.tt))) + 0.3::double * (1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))) end as title,
  case when a.n < 10 or b.n < 10 then 0 else 1 - len(list_filter(range(1, 65), lambda i: a.h[i] <> b.h[i])) / 64 end as content
  from ls a join ls b on a.query_id = b.query_id and a.position < b.position),
sc as (select *, 0.4::double * url + 0.35::double * title + 0.25::double * content as combined, (url >= 0.8::double)::int + (title >= 0.75::double)::int + (content >= 0.7::double)::int as votes from pr)"""
Q["duplicate_pairs"] = (
    _pairs,
    f"with {_LISTS} select query_id, a, b, round(url, 6) as url, round(title, 6) as title, round(content, 6) as content, round(combined, 6) as combined, case when url >= 0.95::double then 'url' when votes >= 2 then 'votes' else 'combined' end as reason from sc where url >= 0.95::double or votes >= 2 or combined >= 0.6::double",
)
Q["result_leaders"] = (lambda s, d: _led(s, d)[2].select("query_id", "doc_id", "leader"), None)
Q["merged_results"] = (_merged, None)
Q["dedup_statistics"] = (_statistics, None)
