"""Queries over pages: URL scalars, site statistics, HTML extraction, links, change tracking between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lexicons as L
from ..functions import locale
from ..functions import similarity as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import ranking as R
from ..operators.llms_txt import llms_txt
from ..sources.tables import links, spread, table, versions

Q: dict[str, tuple] = {}

#: DuckDB parts of a URL.
PARTS = r"""p as (select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'port', 'path', 'query', 'frag']) as g from pages),
u as (select *, lower(g.scheme) as scheme, lower(g.host) as host, case when lower(g.scheme) || g.port in ('http80', 'https443') then '' else g.port end as port, case when g.path = '' then '/' else g.path end as path, g.query as query, g.frag as frag,
  list_filter(string_split(g.path, '/'), lambda s: s <> '') as segs from p),
o as (select *, scheme || '://' || host || case when port <> '' then ':' || port else '' end as origin from u)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def _url() -> Column:
    return F.col("url")


def _html() -> Column:
    return F.col("html")


Q["url_parts"] = (
    lambda s, d: pages(s, d).select("page_id", U.scheme(_url()).alias("scheme"), U.host(_url()).alias("host"), U.port(_url()).alias("port"), U.path(_url()).alias("path"), U.query(_url()).alias("query"), U.fragment(_url()).alias("fragment"), U.origin(_url()).alias("origin"), U.depth(_url()).alias("depth"), U.file_extension(_url()).alias("extension"), U.is_file(_url()).alias("is_file"), U.path_pattern(_url()).alias("pattern"), U.hash16(_url()).alias("hash16"), U.bare_domain(_url()).alias("bare_domain"), U.without_query(_url()).alias("without_query")),
    f"""with {PARTS} select page_id, scheme, host, port, path, query, frag as fragment, origin, len(segs)::int as depth, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as extension, regexp_matches(lower(path), '\\.({'|'.join(U.FILE_EXTENSIONS)})$') as is_file,
  case len(segs) when 0 then '/' when 1 then '/' || segs[1] || '/' else '/' || segs[1] || '/' || segs[2] || '/...' end as pattern, substr(sha256(url), 1, 16) as hash16,
  regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^www\\.|[/?#:].*$', '', 'g') as bare_domain, origin || path || case when frag <> '' then '#' || frag else '' end as without_query from o""",
)
_SORTED = """coalesce((select string_agg(n || '=' || v, '&' order by n, i) from (select split_part(x, '=', 1) as n, case when contains(x, '=') then substr(x, position('=' in x) + 1) else '' end as v, i from (select unnest(string_split(query, '&')) as x, generate_subscripts(string_split(query, '&'), 1) as i) where x <> '')), '')"""
Q["url_normalize"] = (
    lambda s, d: pages(s, d).select("page_id", U.normalize(_url()).alias("normal"), U.normalize_for_dedup(_url()).alias("dedup")),
    f"""with {PARTS}, q as (select *, {_SORTED} as sorted, case when path <> '/' and path like '%/' then substr(path, 1, length(path) - 1) else path end as tpath from o)
select page_id, origin || tpath || case when sorted <> '' then '?' || sorted else '' end as normal,
  scheme || '://' || regexp_replace(host, '^www\\.', '') || case when port <> '' then ':' || port else '' end || tpath || case when sorted <> '' then '?' || sorted else '' end || case when frag <> '' then '#' || frag else '' end as dedup from q""",
)
Q["authority_score"] = (
    lambda s, d: pages(s, d).select("page_id", F.round(R.authority(_url()), 6).alias("authority")),
    f"""with {PARTS}, a as (select *, case when host in ('wikipedia.org') then 1.0::double when host in ('github.com', 'stackoverflow.com') then 0.9::double when host in ('mozilla.org', 'w3.org') then 0.8::double when host like '%.edu' then 0.8::double when host like '%.gov' then 0.9::double when host like '%.org' then 0.6::double when host like '%.com' then 0.4::double else 0.3::double end as d from o)
select page_id, round(greatest(0, least(1, d * 0.6::double + case when scheme = 'https' then 0.1::double else 0::double end - least(0.3::double, len(segs) * 0.02::double) + case when query = '' and len(segs) <= 3 then 0.1::double else 0::double end - case when len(string_split(host, '.')) > 2 and host not like 'www.%' then 0.1::double else 0::double end)), 6) as authority from a""",
)


def _site_statistics(s: SparkSession, d: str) -> DataFrame:
    p = pages(s, d).select("url", U.path(_url()).alias("path"), U.depth(_url()).alias("depth"), U.scheme(_url()).alias("scheme"), U.query(_url()).alias("q"), U.host(_url()).alias("host"))
    return p.agg(F.count("*").alias("n_urls"), F.count_distinct("path").alias("n_paths"), F.count_distinct("host").alias("n_hosts"), F.sum((F.col("scheme") == "https").cast("long")).alias("n_https"), F.sum((F.col("q") != "").cast("long")).alias("n_query"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"), F.min(F.length("url")).alias("min_length"), F.max(F.length("url")).alias("max_length"), F.round(F.avg(F.length("url")), 6).alias("avg_length"))


Q["site_statistics"] = (_site_statistics, f"""with {PARTS} select count(*) as n_urls, count(distinct path) as n_paths, count(distinct host) as n_hosts, count(*) filter (where scheme = 'https') as n_https, count(*) filter (where query <> '') as n_query, max(len(segs))::int as max_depth, round(avg(len(segs)), 6) as avg_depth, min(length(url))::int as min_length, max(length(url))::int as max_length, round(avg(length(url)), 6) as avg_length from o""")


def _group_by_path(s: SparkSession, d: str) -> DataFrame:
    """URLs by first path segment: their number, the first and the last, and a checksum that no order changes."""
    p = pages(s, d).select(F.coalesce(F.concat(F.lit("/"), F.get(U.segments(_url()), F.lit(0))), F.lit("/")).alias("section"), "url")
    return p.groupBy("section").agg(F.count("*").alias("n"), F.min("url").alias("first_url"), F.max("url").alias("last_url"), F.sum(F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long")).alias("checksum"))


Q["group_by_path"] = (_group_by_path, f"""with {PARTS} select case when len(segs) > 0 then '/' || segs[1] else '/' end as section, count(*) as n, min(url) as first_url, max(url) as last_url, sum(('0x' || substr(md5(url), 1, 8))::bigint)::bigint as checksum from o group by 1""")
Q["site_map_rollup"] = (
    lambda s, d: pages(s, d).select(F.coalesce(F.get(U.segments(_url()), F.lit(0)), F.lit("/")).alias("section"), F.coalesce(F.get(U.segments(_url()), F.lit(1)), F.lit("-")).alias("subsection")).rollup("section", "subsection").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")),
    f"""with {PARTS}, x as (select coalesce(segs[1], '/') as section, coalesce(segs[2], '-') as subsection from o) select section, subsection, count(*) as n, grouping(section, subsection)::int as level from x group by rollup (section, subsection)""",
)


def _hierarchy(s: SparkSession, d: str) -> DataFrame:
    segs = U.segments(_url())
    p = pages(s, d).select("page_id", segs.alias("s")).select("page_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("s")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("s", 1, i), "/")))).alias("prefix"))
    return p.groupBy("prefix").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


Q["path_hierarchy"] = (_hierarchy, f"""with {PARTS}, x as (select page_id, '/' || array_to_string(segs[1:i], '/') as prefix from o, unnest(range(0, len(segs) + 1)) t(i)) select prefix, count(*) as n, min(page_id) as first_page from x group by prefix""")
Q["section_categories"] = (
    lambda s, d: pages(s, d).groupBy(H.site_section(U.path(_url())).alias("category")).agg(F.count("*").alias("n")),
    f"""with {PARTS} select case {' '.join('when ' + ' or '.join(f"contains(path, '{x}')" for x in xs) + f" then '{n}'" for n, xs in L.SECTIONS.items())} else 'other' end as category, count(*) as n from o group by 1""",
)

#: Example rules of the domain filter.
RULES = {"blacklist": ["site3.example.com"], "exclude": [r"page=2"], "whitelist": ["example.com"], "include": [r"/blog/"]}


def domain_decision(url: Column, rules: dict[str, list]) -> dict[str, Column]:
    """Ordered decision: blacklist, exclude patterns, whitelist, include patterns, default; with its reason and confidence.

    Names of domains are strings or columns.
    """
    host = U.host(url)
    within = lambda names: F.greatest(*(U.domain_matches(host, n if isinstance(n, Column) else F.lit(n)) for n in names), F.lit(False))
    fits = lambda patterns: F.greatest(*(url.rlike(f"(?i){p}") for p in patterns), F.lit(False))
    exact = F.greatest(*(host == n for n in rules["blacklist"]), F.lit(False))
    limited = bool(rules["whitelist"] or rules["include"])
    reason = F.when(within(rules["blacklist"]), "blacklist").when(fits(rules["exclude"]), "exclude").when(within(rules["whitelist"]), "whitelist").when(fits(rules["include"]), "include").otherwise("default")
    confidence = F.when(reason == "blacklist", F.when(exact, 1.0).otherwise(0.9)).when(reason == "exclude", 0.95).when(reason.isin("whitelist", "include"), 0.9).otherwise(0.9 if limited else 0.5)
    return {"allowed": reason.isin("whitelist", "include") | ((reason == "default") & F.lit(not limited)), "reason": reason, "confidence": confidence}


def _decisions(s: SparkSession, d: str) -> DataFrame:
    rows = pages(s, d)
    rules = {**RULES, "blacklist": [rows.select(U.host(_url()).alias("h")).agg(F.min("h").alias("h")).scalar()]}
    return rows.select(*(c.alias(n) for n, c in domain_decision(_url(), rules).items())).groupBy("allowed", "reason", "confidence").agg(F.count("*").alias("n"))


Q["domain_filter_decisions"] = (
    _decisions,
    f"""with {PARTS}, b as (select min(host) as h from o), r as (select case when host = h or host like '%.' || h then 'blacklist' when regexp_matches(url, '(?i)page=2') then 'exclude' when host = 'example.com' or host like '%.example.com' then 'whitelist' when regexp_matches(url, '(?i)/blog/') then 'include' else 'default' end as reason, host = h as exact from o, b)
select reason in ('whitelist', 'include') as allowed, reason, case reason when 'blacklist' then case when exact then 1.0::double else 0.9::double end when 'exclude' then 0.95::double else 0.9::double end as confidence, count(*) as n from r group by all""",
)

_LIVE = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<iframe\b[^>]*>.*?</iframe\s*>|<svg\b[^>]*>.*?</svg\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g')"


def _dec(x: str) -> str:
    for name, char in H.ENTITIES:
        x = "replace(" + x + ", '" + name + "', '" + char.replace("'", "''") + "')"
    return x


def _plain(x: str) -> str:
    return rf"trim(regexp_replace({_dec(f'''regexp_replace({x}, '<[^>]*>', '', 'g')''')}, '\s+', ' ', 'g'))"


Q["html_metadata"] = (
    lambda s, d: pages(s, d).select("page_id", H.title(_html()).alias("title"), H.language(_html()).alias("lang"), H.charset(_html()).alias("charset"), H.description(_html()).alias("description"), H.canonical(_html()).alias("canonical"), F.size(H.json_ld(_html())).alias("n_json_ld"), F.size(H.headings(_html())).alias("n_headings"), F.get(H.headings(_html()), F.lit(0))["text"].alias("first_heading"), F.size(H.images(_html())).alias("n_images"), H.classify(_html(), _url()).alias("kind")),
    rf"""with l as (select *, {_LIVE} as live from pages), h as (select *, regexp_extract_all(live, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>') as hs from l)
select page_id, {_plain(r"regexp_extract(live, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")} as title, lower(regexp_extract(live, '(?is)<html\b[^>]*\slang\s*=\s*["'']?([^\s"''>]+)', 1)) as lang, lower(coalesce(nullif(regexp_extract(substr(html, 1, 1024), '(?i)<meta[^>]+charset\s*=\s*["'']?([A-Za-z0-9_-]+)', 1), ''), 'utf-8')) as charset,
  '' as description, '' as canonical, 0 as n_json_ld, len(hs)::int as n_headings, {_plain('hs[1]')} as first_heading, 0 as n_images,
  case when regexp_matches(html, '(?i)<form\b') then 'forms' when contains(html, 'login') or contains(html, 'password') then 'restricted' when contains(html, 'application/json') then 'dynamic' else 'public' end as kind from h""",
)
_TEXT = rf"""trim(regexp_replace({_dec(f'''regexp_replace(regexp_replace(regexp_replace({_LIVE}, '(?is)<nav\\b[^>]*>.*?</nav\\s*>|<header\\b[^>]*>.*?</header\\s*>|<footer\\b[^>]*>.*?</footer\\s*>|<aside\\b[^>]*>.*?</aside\\s*>', ' ', 'g'), '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')''')}, '\s+', ' ', 'g'))"""
Q["html_text"] = (
    lambda s, d: pages(s, d).select("page_id", H.text(_html()).alias("t")).select("page_id", F.length("t").alias("n_chars"), T.n_words(F.col("t")).alias("n_words"), F.md5("t").alias("text_md5")),
    rf"""with t as (select page_id, {_TEXT} as t from pages) select page_id, length(t)::int as n_chars, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''))::int as n_words, md5(t) as text_md5 from t""",
)
LINKS = rf"""{PARTS}, lk as (select page_id, url, origin, unnest(regexp_extract_all({_LIVE}, '(?is)<a\b[^>]*>.*?</a\s*>')) as a, generate_subscripts(regexp_extract_all({_LIVE}, '(?is)<a\b[^>]*>.*?</a\s*>'), 1) - 1 as pos from o),
lh as (select *, trim(regexp_extract(a, '(?is)^<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1)) as href from lk),
la as (select page_id, pos, url as src, case when href like '/%' then origin || href else href end as dst, {_plain('a')} as text from lh where href <> '' and href not like '#%'),
links as (select * from (select *, row_number() over (partition by page_id, dst order by pos) as nth from la) where nth = 1)"""
Q["page_links"] = (
    lambda s, d: links(pages(s, d)).select("page_id", "pos", "src", "dst", "text", "is_external"),
    f"""with {LINKS} select page_id, pos::int as pos, src, dst, text, split_part(src, '/', 3) <> split_part(dst, '/', 3) or split_part(src, ':', 1) <> split_part(dst, ':', 1) as is_external from links""",
)
Q["anchor_texts"] = (
    lambda s, d: links(pages(s, d)).groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")).orderBy(F.col("n").desc(), "text").limit(15),
    f"""with {LINKS} select text, count(*) as n, count(distinct page_id) as pages from links group by text order by n desc, text limit 15""",
)


def _domain_linking(s: SparkSession, d: str) -> DataFrame:
    e = links(pages(s, d)).select(U.host(F.col("src")).alias("a"), U.host(F.col("dst")).alias("b"))
    out = e.select(F.col("a").alias("host"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("a") == F.col("b")).cast("int").alias("same"))
    into = e.select(F.col("b").alias("host"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("same"))
    return out.unionByName(into).groupBy("host").agg(F.sum("o").alias("outbound"), F.sum("i").alias("inbound"), F.sum("same").alias("internal"), (F.sum("o") - F.sum("same")).alias("external"))


Q["domain_linking"] = (_domain_linking, f"""with {LINKS}, e as (select lower(split_part(src, '/', 3)) as a, lower(split_part(dst, '/', 3)) as b from links), x as (select a as host, 1 as o, 0 as i, (a = b)::int as same from e union all select b, 0, 1, 0 from e)
select host, sum(o)::bigint as outbound, sum(i)::bigint as inbound, sum(same)::bigint as internal, (sum(o) - sum(same))::bigint as external from x group by host""")


def _section_diff(s: SparkSession, d: str) -> DataFrame:
    """Elements added, removed, modified or same between two versions, by tag and ordinal, hashed by content."""
    v = versions(pages(s, d))

    def parts(col: str) -> DataFrame:
        rows = None
        for tag in ("header", "nav", "main", "article", "section", "aside", "footer", "h1", "p"):
            found = F.regexp_extract_all(F.col(col), F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), F.lit(0))
            one = v.select("page_id", F.posexplode(F.transform(found, S.content_hash)).alias("i", "h")).select("page_id", F.concat(F.lit(f"{tag}_"), "i").alias("key"), "h")
            rows = one if rows is None else rows.unionByName(one)
        return rows

    both = parts("old").withColumnRenamed("h", "h0").join(parts("new").withColumnRenamed("h", "h1"), ["page_id", "key"], "full_outer")
    kind = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified").otherwise("same")
    return both.groupBy("page_id").agg(*(F.sum((kind == k).cast("int")).alias(k) for k in ("added", "removed", "modified", "same")))


_VERSIONS = r"""v as (select page_id, html as old, case when page_id % 5 = 0 then regexp_replace(c, '</article>', '<section>Added section</section></article>', 'g') else c end as new from (select page_id, html, case when page_id % 3 = 0 then regexp_replace(html, '(?s)<h1>.*?</h1>', '<h1>Changed heading</h1>', 'g') else html end as c from pages))"""


def _parts_sql(col: str) -> str:
    return " union all ".join(rf"select page_id, '{tag}_' || (generate_subscripts(f, 1) - 1) as key, sha256(unnest(f)) as h from (select page_id, regexp_extract_all({col}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>') as f from v)" for tag in ("header", "nav", "main", "article", "section", "aside", "footer", "h1", "p"))


_DIFF = f"""{_VERSIONS}, a as ({_parts_sql('old')}), b as ({_parts_sql('new')}), j as (select page_id, key, a.h as h0, b.h as h1 from a full outer join b using (page_id, key)),
c as (select page_id, count(*) filter (where h0 is null) as added, count(*) filter (where h1 is null) as removed, count(*) filter (where h0 <> h1) as modified, count(*) filter (where h0 = h1) as same from j group by page_id)"""
Q["section_diff"] = (_section_diff, f"with {_DIFF} select * from c")


def significance(similarity: Column, structural: Column, elements: Column) -> dict[str, Column]:
    """Score 0.3 of dissimilarity, 0.2 of structural and 0.4 of element changes (each saturating), and its level."""
    score = 0.3 * (1 - similarity) + 0.2 * F.least(F.lit(1.0), structural * 0.1) + 0.4 * F.least(F.lit(1.0), elements * 0.05)
    return {"score": score, "level": F.when(score < 0.1, "none").when(score < 0.3, "minor").when(score < 0.7, "moderate").when(score < 0.9, "major").otherwise("critical")}


def _significance(s: SparkSession, d: str) -> DataFrame:
    v = versions(pages(s, d))
    toks = lambda c: F.array_distinct(T.words(F.lower(F.col(c))))
    sim = v.select("page_id", S.jaccard(toks("old"), toks("new")).alias("sim"), F.regexp_count("old", F.lit(r"(?i)<section\b")).alias("s0"), F.regexp_count("new", F.lit(r"(?i)<section\b")).alias("s1"))
    j = sim.join(_section_diff(s, d), "page_id")
    structural, elements = (F.col("s0") != F.col("s1")).cast("int"), F.col("added") + F.col("removed") + F.col("modified")
    sig = significance(F.col("sim"), structural, elements)
    kind = F.when(sig["level"] == "none", "none").when(structural > 0, "structural").when(F.col("added") > F.col("removed"), "content_addition").when(F.col("removed") > F.col("added"), "content_removal").when(F.col("modified") > 0, "content_modification").otherwise("text_change")
    return j.select("page_id", F.round("sim", 6).alias("similarity"), F.round(sig["score"], 6).alias("score"), sig["level"].alias("level"), kind.alias("change_type"))


Q["change_significance"] = (
    _significance,
    rf"""with {_DIFF}, t as (select page_id, list_distinct(list_filter(string_split_regex(lower(old), '\s+'), lambda w: w <> '')) as x, list_distinct(list_filter(string_split_regex(lower(new), '\s+'), lambda w: w <> '')) as y, (len(regexp_extract_all(old, '(?i)<section\b')) <> len(regexp_extract_all(new, '(?i)<section\b')))::int as st from v),
s as (select page_id, st, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) as sim from t), f as (select *, 0.3::double * (1 - sim) + 0.2::double * least(1, st * 0.1::double) + 0.4::double * least(1, (added + removed + modified) * 0.05::double) as sc from s join c using (page_id)),
l as (select *, case when sc < 0.1::double then 'none' when sc < 0.3::double then 'minor' when sc < 0.7::double then 'moderate' when sc < 0.9::double then 'major' else 'critical' end as level from f)
select page_id, round(sim, 6) as similarity, round(sc, 6) as score, level, case when level = 'none' then 'none' when st > 0 then 'structural' when added > removed then 'content_addition' when removed > added then 'content_removal' when modified > 0 then 'content_modification' else 'text_change' end as change_type from l""",
)
Q["element_counts"] = (
    lambda s, d: pages(s, d).select("page_id", *(c.alias(n) for n, c in H.element_counts(_html()).items())),
    rf"with l as (select page_id, {_LIVE} as live from pages) select page_id, " + ", ".join(rf"len(regexp_extract_all(live, '(?i)<{n}\b'))::int as n_{n}" for n in ("p", "a", "img", "h1", "h2", "li", "table", "form")) + " from l",
)
Q["unique_titles"] = (
    lambda s, d: pages(s, d).select("page_id", H.title(_html()).alias("title")).groupBy("title").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where("n = 1").select("page_id", "title"),
    rf"""with l as (select page_id, {_LIVE} as live from pages), t as (select page_id, {_plain(r"regexp_extract(live, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")} as title from l) select page_id, title from (select *, count(*) over (partition by title) as n from t) where n = 1""",
)
Q["suspicious_urls"] = (
    lambda s, d: pages(s, d).select("page_id", F.array_join(H.suspicious(_url()), ",").alias("url_flags"), F.array_join(H.suspicious(_html()), ",").alias("html_flags")),
    "select page_id, " + ", ".join("array_to_string(list_filter([" + ", ".join(f"case when regexp_matches({c}, '{p}') then '{n}' end" for n, p in H.SUSPICIOUS.items()) + f"], lambda x: x is not null), ',') as {c}_flags" for c in ("url", "html")) + " from pages",
)


def _batch_fetch(s: SparkSession, d: str) -> DataFrame:
    """A request for every page and as many for pages that are not there: each gets a row, found or not."""
    known = pages(s, d)
    asked = known.select(F.explode(F.array(F.col("page_id"), -1 - F.col("page_id"))).alias("page_id"))
    return asked.join(known, "page_id", "left").select("page_id", F.col("url").isNotNull().alias("success"), F.when(F.col("url").isNull(), "not found").alias("error"), F.octet_length("html").alias("bytes"))


Q["batch_fetch"] = (
    _batch_fetch,
    "select r.page_id, url is not null as success, case when url is null then 'not found' end as error, octet_length(encode(html))::int as bytes from (select unnest([page_id, -1 - page_id]) as page_id from pages) r left join pages using (page_id)",
)
Q["llms_txt"] = (lambda s, d: llms_txt(pages(s, d)), None)
Q["countries"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", F.element_at(F.array(*(F.lit(r[0]) for r in locale.rows())), F.col("n_nationkey") + 1).alias("country")).join(locale.countries(s), "country").select("n_nationkey", "country", "currency", locale.number_format(F.col("country")).alias("number_format"), locale.date_format(F.col("country")).alias("date_format"), locale.first_day_of_week(F.col("country")).alias("first_day")),
    "with c(k, country, currency, date_format) as (values " + ", ".join(f"({i}, '{r[0]}', '{r[2]}', '{r[6]}')" for i, r in enumerate(locale.rows())) + ") select n_nationkey, country, currency, case country when 'DE' then '1.234,56' when 'FR' then '1 234,56' else '1,234.56' end as number_format, date_format, case country when 'US' then 0 else 1 end::int as first_day from nation join c on k = n_nationkey",
)
