"""Queries of small rules: crawling, sources, responses, topics, monitors, sinks, changes, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lexicons as L
from ..functions import registry as REG
from ..functions import rules as K
from ..functions import text as T
from ..functions import urls as U
from ..operators import changes as C
from ..operators import entities as E
from ..operators import metrics as M
from ..operators.monitors import run_due
from ..sources.tables import SEARCH_SQL, search_rows, spread, table, versions
from .corpus import _LANG, SENTENCES, WORDS
from .history import events
from .site import _LIVE, _TEXT, _VERSIONS, PARTS

Q: dict[str, tuple] = {}
INCLUDE, EXCLUDE = [r"/en/", r"/fr/"], [r"page=\d"]


def pages(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "pages"))


def docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"))


Q["crawl_predicates"] = (
    lambda s, d: pages(s, d).select("page_id", K.should_crawl(F.col("url"), INCLUDE, EXCLUDE).alias("crawl"), K.needs_rendering(F.col("url")).alias("rendered"), K.sanitized_url(F.col("url")).alias("clean"), K.source_of(F.col("url")).alias("kind"), K.api_type(U.path(F.col("url"))).alias("api"), K.security_area(U.path(F.col("url"))).alias("area")),
    rf"""with {PARTS} select page_id, (regexp_matches(url, '/en/') or regexp_matches(url, '/fr/')) and not regexp_matches(url, 'page=\d') as crawl, regexp_matches(split_part(url, '#', 1), '/(app|spa|dashboard|admin)(/|$)') or regexp_matches(split_part(url, '#', 1), '\.(js|jsx|ts|tsx)$') as rendered,
  regexp_replace(split_part(url, '#', 1), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1') as clean, case when lower(regexp_replace(url, '[?#].*$', '')) like '%.pdf' then 'pdf' else 'url' end as kind,
  case when contains(lower(path), 'graphql') then 'graphql' when contains(lower(path), 'swagger') or contains(lower(path), 'openapi') then 'openapi' when contains(lower(path), '/rest') or contains(lower(path), '/api') then 'rest' when contains(lower(path), 'rss') or contains(lower(path), 'feed') then 'feed' else 'unknown' end as api,
  case when regexp_matches(lower(path), 'login|signin|auth') then 'authentication' when contains(lower(path), 'admin') then 'administration' when regexp_matches(lower(path), 'account|profile') then 'account' when regexp_matches(lower(path), 'checkout|payment') then 'payment' else 'none' end as area from o""",
)

#: Rules of domains: name, depth, pages.
DOMAIN_RULES = [("example.com", 3, 50), ("example.net", 2, 20), ("ththth.example.net", 1, 10)]


def domain_rules(rows: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """``rows`` with the settings of their host: its own rule, else of the nearest parent domain, else the defaults."""
    labels = F.split("h", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(F.col(host).alias("h")).where("h is not null").distinct().withColumn("domain", F.explode(above))
    best = hosts.join(F.broadcast(rules), "domain").groupBy("h").agg(F.max_by(F.struct("domain", "max_depth", "max_pages"), F.length("domain")).alias("r"))
    out = rows.join(best, F.col(host) == F.col("h"), "left")
    return out.select(*rows.columns, F.col("r.domain").alias("rule"), F.coalesce("r.max_depth", F.lit(K.DOMAIN_DEFAULTS["max_depth"])).alias("max_depth"), F.coalesce("r.max_pages", F.lit(K.DOMAIN_DEFAULTS["max_pages"])).alias("max_pages"))


Q["domain_rules"] = (
    lambda s, d: domain_rules(pages(s, d).select("page_id", U.host(F.col("url")).alias("host")), s.createDataFrame(DOMAIN_RULES, "domain string, max_depth int, max_pages int")),
    f"with {PARTS}, r(domain, max_depth, max_pages) as (values " + ", ".join(map(str, DOMAIN_RULES)) + "), b as (select page_id, max_by((domain, max_depth, max_pages), length(domain)) as r from o join r on host = domain or host like '%.' || domain group by page_id) select page_id, host, r[1] as rule, coalesce(r[2], 5)::int as max_depth, coalesce(r[3], 100)::int as max_pages from o left join b using (page_id)",
)
Q["relevant_documents"] = (
    lambda s, d: docs(s, d).select("doc_id", K.is_relevant(F.col("text"), "research on languages").alias("relevant"), K.geo_blocked(F.lit(None).cast("int"), F.col("text")).alias("blocked"), K.looks_english(F.col("text")).alias("english"), K.language_confidence(F.col("text")).alias("confidence")),
    "select doc_id, text = '' or contains(lower(text), 'research') or contains(lower(text), 'languages') as relevant, " + " or ".join(f"regexp_matches(text, '{p}')" for p in K.GEO_BLOCKING) + r""" as blocked,
  length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(1, length(regexp_replace(text, '\s', '', 'g'))) > 0.7::double and (""" + " + ".join(f"contains(lower(text), '{m}')::int" for m in K.ENGLISH_MARKERS) + ") >= 2 as english, floor(least(1, 0.5::double + length(text) / 500 * 0.5::double) * 100 + 0.5) / 100 as confidence from documents",
)
_KIND = "case when host like '%.gov' then 'government' when host like '%.edu' then 'academic' when host like '%.com' then 'commercial' end"


def _preferred(s: SparkSession, d: str) -> DataFrame:
    """Sources of the wanted kinds; one whose kind is not known passes."""
    rows = search_rows(docs(s, d)).select("doc_id", U.host(F.col("link")).alias("host"))
    kind = F.when(F.col("host").endswith(".gov"), "government").when(F.col("host").endswith(".edu"), "academic").when(F.col("host").endswith(".com"), "commercial")
    return rows.where(K.preferred(kind, F.lit(None).cast("double"), ["academic", "government"], True)).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


Q["preferred_sources"] = (_preferred, "with " + SEARCH_SQL + f", h as (select split_part(split_part(link, '//', 2), '/', 1) as host from rows) select {_KIND} as kind, count(*) as n from h where {_KIND} is null or {_KIND} in ('academic', 'government') group by 1")


def _variations(s: SparkSession, d: str) -> DataFrame:
    """Queries on each nation by approach, the nation's own first, then by score and text."""
    n = table(s, d, "nation").select(F.lower("n_name").alias("topic"))
    rows = None
    for approach in K.VARIATIONS:
        one = n.select("topic", F.lit(approach).alias("approach"), F.explode(K.variations(F.col("topic"), approach)).alias("query"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("score", F.round(K.query_score(F.col("query"), F.col("topic")), 6))


_V = ", ".join(f"('{a}', '{v}')" for a, vs in K.VARIATIONS.items() for v in ["{}", *vs])
Q["research_queries"] = (
    _variations,
    f"""with v(approach, pattern) as (values {_V}), q as (select lower(n_name) as topic, approach, replace(pattern, '{{}}', lower(n_name)) as query from nation, v)
select topic, approach, query, round(case when query = topic then 1 else 0.5::double + 0.3::double * len(list_filter(string_split(topic, ' '), lambda w: list_contains(string_split(query, ' '), w))) / len(string_split(topic, ' ')) + case when {' or '.join(f"contains(query, '{w}')" for w in K.RESEARCH_WORDS)} then 0.2::double else 0 end + case when length(query) > 10 and length(query) < 100 then 0.1::double else 0 end end, 6) as score from q""",
)
Q["file_statistics"] = (
    lambda s, d: docs(s, d).select("doc_id", F.size(F.split("text", "\n")).alias("lines"), T.n_words(F.col("text")).alias("words"), F.length("text").alias("characters"), F.round(T.n_solid(F.col("text")) / F.greatest(T.n_words(F.col("text")), F.lit(1)), 6).alias("chars_per_word")),
    rf"select doc_id, len(string_split(text, chr(10)))::int as lines, len({WORDS})::int as words, length(text)::int as characters, round(length(regexp_replace(text, '\s', '', 'g')) / greatest(1, len({WORDS})), 6) as chars_per_word from documents",
)
Q["language_comparison"] = (
    lambda s, d: docs(s, d).select("source", "lang", T.readability(F.col("text"))["by_length"].alias("r"), T.sentiment(F.col("text"))["polarity"].alias("p")).groupBy("source").agg(F.count_distinct("lang").alias("languages"), F.round(F.avg("r"), 4).alias("avg_readability"), F.round(F.min("r"), 4).alias("min_readability"), F.round(F.max("r"), 4).alias("max_readability"), (F.max("r") - F.min("r") < 20).alias("consistent"), F.round(F.avg("p"), 6).alias("avg_polarity"), F.min("p").alias("min_polarity"), F.max("p").alias("max_polarity")),
    None,
)


def _themes(s: SparkSession, d: str) -> DataFrame:
    """Topic categories of two documents or more of a source, and the categories that only one source has."""
    rows = docs(s, d).select("source", T.topic_category(F.col("text")).alias("category"))
    counts = rows.groupBy("source", "category").agg(F.count("*").alias("n"))
    spread_over = counts.groupBy("category").agg(F.count("*").alias("sources"))
    return counts.where("n >= 2").join(F.broadcast(spread_over), "category").select("source", "category", "n", (F.col("sources") > 1).alias("common"))


_CATEGORY = "case " + " ".join(rf"when regexp_matches(lower(text), '\b({'|'.join(k)})\b') then '{n}'" for n, k in L.TOPICS.items()) + " else 'general' end"
Q["themes"] = (_themes, f"with c as (select source, {_CATEGORY} as category, count(*) as n from documents group by all), s as (select category, count(*) as sources from c group by category) select source, category, n, sources > 1 as common from c join s using (category) where n >= 2")
Q["url_distributions"] = (
    lambda s, d: pages(s, d).select(F.explode(F.array(F.struct(F.lit("host").alias("kind"), U.host(F.col("url")).alias("value")), F.struct(F.lit("depth").alias("kind"), U.depth(F.col("url")).cast("string").alias("value")))).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n")),
    f"with {PARTS} select 'host' as kind, host as value, count(*) as n from o group by host union all select 'depth', len(segs)::varchar, count(*) from o group by 2",
)
Q["spread_of_values"] = (
    lambda s, d: events(s, d).groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation")),
    "select event_type, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation from events group by event_type",
)
Q["prometheus_lines"] = (
    lambda s, d: M.prometheus(events(s, d).withColumn("failed", F.col("event_type") == "error"), "event_type", "value", "failed"),
    """with t as (select event_type as k, count(*) as n, count(*) filter (where event_type = 'error') as f, round(sum(value), 4) as s, """ + ", ".join(f"count(*) filter (where value <= {b}) as b{b}" for b in M.BOUNDS) + """ from events group by 1)
select 'weft_calls_total{name="' || k || '"} ' || n as line from t union all select 'weft_errors_total{name="' || k || '"} ' || f from t union all select 'weft_duration_count{name="' || k || '"} ' || n from t
union all select 'weft_duration_bucket{name="' || k || '",le="+Inf"} ' || n from t """ + " ".join(f"""union all select 'weft_duration_bucket{{name="' || k || '",le="{b}"}} ' || b{b} from t""" for b in M.BOUNDS),
)
Q["csv_lines"] = (
    lambda s, d: M.csv_lines(events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")), ["event_type", "n", "first_event"]),
    "select event_type || ',' || count(*) || ',' || min(event_id) as line from events group by event_type",
)


def _monitors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(F.col("page_id").alias("id"), "url", (F.lit(60_000) * (F.col("page_id") % 5 + 1)).alias("interval"), (F.col("page_id") * 40_000).alias("next_due"), (F.col("page_id") % 7 != 0).alias("enabled"))


Q["due_monitors"] = (
    lambda s, d: run_due(_monitors(s, d), 1_000_000),
    "select id, due, missed, case when due then next_due + (floor((1000000 - next_due) / interval)::bigint + 1) * interval else next_due end as next_due from (select page_id as id, 60000 * (page_id % 5 + 1) as interval, page_id * 40000 as next_due, page_id % 7 <> 0 and page_id * 40000 <= 1000000 as due, case when page_id % 7 <> 0 and page_id * 40000 <= 1000000 then floor((1000000 - page_id * 40000) / (60000 * (page_id % 5 + 1)))::bigint else 0 end as missed from pages)",
)
Q["metrics_summary"] = (
    lambda s, d: M.summary(events(s, d), "event_type", "value", F.col("event_type") == "error"),
    "select count(*) as calls, round(count(*) filter (where event_type = 'error') / count(*), 6) as error_rate, round(count(*) / greatest(1, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) as per_second, (select event_type from events group by 1 order by count(*) desc, event_type limit 1) as most_used, round(avg(value), 6) as avg_value from events",
)


def _links_changed(s: SparkSession, d: str) -> DataFrame:
    """Links added, removed and with another text between two versions of a page."""
    v = versions(pages(s, d)).withColumn("new", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("new", r"(?s)<li>.*?</li>", "<li><a href=\"/new\">New</a></li>")).otherwise(F.col("new")))
    rows = v.select("page_id", H.anchors(F.col("old")).alias("a"), H.anchors(F.col("new")).alias("b"))
    return rows.select("page_id", *(F.size(c).alias(k) for k, c in C.keyed_changes(F.col("a"), F.col("b"), "href", "text").items()))


Q["link_changes"] = (_links_changed, None)
_DIFF_WORDS = rf"{_VERSIONS}, w as (select page_id, string_split_regex(old, '\s+') as a, string_split_regex(new, '\s+') as b from v)"
Q["differential_words"] = (
    lambda s, d: versions(pages(s, d)).select("page_id", *(F.size(c).alias(k) for k, c in C.differing_words(F.col("old"), F.col("new")).items())),
    f"with {_DIFF_WORDS} select page_id, len(list_filter(b, lambda x: not list_contains(a, x)))::int as added, len(list_filter(a, lambda x: not list_contains(b, x)))::int as removed from w",
)
_TAGS = "list_transform(regexp_extract_all({}, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))"
Q["structural_similarity"] = (
    lambda s, d: versions(pages(s, d)).select("page_id", F.round(C.structural_similarity(F.col("old"), F.col("new")), 6).alias("similarity")),
    f"with {_VERSIONS}, t as (select page_id, list_distinct({_TAGS.format(_LIVE.replace('html', 'old'))}) as a, list_distinct({_TAGS.format(_LIVE.replace('html', 'new'))}) as b from v) select page_id, round((len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) + 1) / 2, 6) as similarity from t",
)


def _advice(s: SparkSession, d: str) -> DataFrame:
    from .site import Q as SITE

    rows = SITE["change_significance"][0](s, d)
    return rows.select("page_id", F.array_join(F.transform(C.recommendations(F.col("level"), F.col("change_type"), F.col("similarity")), lambda r: r["type"]), ",").alias("advice"))


def _advice_sql() -> str:
    from .site import Q as SITE

    return f"select page_id, array_to_string(list_filter([case when level = 'critical' then 'alert' end, case when change_type = 'structural' then 'monitoring' end, case when similarity < 0.5 then 'analysis' end], lambda x: x is not null), ',') as advice from ({SITE['change_significance'][1]})"


Q["change_advice"] = (_advice, _advice_sql())
Q["text_diff"] = (lambda s, d: C.text_changes(versions(pages(s, d)), "page_id", "old", "new").select("page_id", F.md5("word_diff").alias("words_md5"), F.size(F.from_json("line_diff", "array<string>")).alias("line_runs")), None)
Q["page_baselines"] = (
    lambda s, d: C.baseline(pages(s, d)).select("url", "version", "content_hash", "content_length", F.size("sections").alias("n_sections")),
    r"select url, 1 as version, sha256(html) as content_hash, length(html)::int as content_length, (" + " + ".join(rf"len(regexp_extract_all(html, '(?is)<{t}\b[^>]*>.*?</{t}\s*>'))" for t in C.SECTIONS) + ")::int as n_sections from pages",
)
Q["entity_counts"] = (lambda s, d: E.entity_counts(E.with_entities(docs(s, d))), None)


def _summary_confidence(s: SparkSession, d: str) -> DataFrame:
    """Confidence in the first three sentences as a summary."""
    lead = F.array_join(F.slice(T.sentences(F.col("text")), 1, 3), " ")
    return docs(s, d).select("doc_id", K.summary_confidence(F.col("text"), lead).alias("confidence"))


_LONG = r"list_filter(string_split_regex(lower({}), '\s+'), lambda w: length(w) > 2)"
Q["summary_confidence"] = (
    _summary_confidence,
    rf"""with t as (select doc_id, text, array_to_string(({SENTENCES})[1:3], ' ') as s from documents), w as (select *, {_LONG.format('s')} as sw, {_LONG.format('text')} as tw from t),
c as (select *, list_distinct(sw) as su, list_distinct(tw) as tu, length(s) / length(text) as r from w)
select doc_id, case when len(sw) = 0 or len(tw) = 0 then 0 else floor(greatest(0, least(1, 0.5::double * len(list_intersect(su, tu)) / least(len(su), len(tu)) + 0.3::double * case when r > 0.1::double and r < 0.8::double then 1 else 0.5::double end + 0.2::double * case when len(sw) between 10 and 200 then 1 else 0.7::double end)) * 100 + 0.5) / 100 end as confidence from c""",
)
Q["page_language"] = (
    lambda s, d: pages(s, d).select("page_id", H.language(F.col("html")).alias("declared"), T.language(H.text(F.col("html"))).alias("found")).select("page_id", K.page_language(F.col("declared"), F.lit(""), F.col("found")).alias("x")).select("page_id", "x.language", F.round("x.confidence", 6).alias("confidence")),
    rf"""with t as (select page_id, {_TEXT} as text, lower(regexp_extract({_LIVE}, '(?is)<html\b[^>]*\slang\s*=\s*["'']?([^\s"''>]+)', 1)) as declared from pages), h as (select page_id, declared, len({WORDS}) as n, {_LANG} from t), g as (select *, greatest({', '.join(L.STOP_WORDS)}) as top from h),
f as (select page_id, declared, case when top = 0 then null {' '.join(f"when {x} = top then '{x}'" for x in L.STOP_WORDS)} end as language, least(95, floor(top / greatest(n, 1) * 250 + 0.5)) as c from g)
select page_id, coalesce(nullif(declared, ''), language) as language, round(case when declared <> '' then 0.3::double else 0 end + case when language is null then 0 else c / 100 * case when declared <> '' then 0.2::double else 0.6::double end end, 6) as confidence from f""",
)
EVIDENCE = "studies of that language with data"
Q["evidence_order"] = (
    lambda s, d: search_rows(docs(s, d)).select("doc_id", K.evidence_score(U.host(F.col("link")).endswith(".edu"), F.concat_ws(" ", "link", "title", "snippet"), EVIDENCE).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20),
    "with " + SEARCH_SQL + ", e as (select doc_id, lower(link || ' ' || title || ' ' || snippet) as c, split_part(split_part(link, '//', 2), '/', 1) like '%.edu' as p from rows) select doc_id, (case when p then 1000 else 0 end + " + " + ".join(f"contains(c, '{t}')::int" for t in EVIDENCE.split() if len(t) > 3) + ")::int as score from e order by score desc, doc_id limit 20",
)
Q["service_metrics"] = (
    lambda s, d: M.service_metrics(events(s, d), "user_id", F.col("event_type") == "error", "ms", 5 * 86_400_000),
    "with e as (select user_id, event_type, epoch_us(ts) / 1000 as ms from events) select user_id, count(*) as calls, count(*) filter (where event_type = 'error') as failures, count(*) filter (where event_type <> 'error') as successes, round(100 * count(*) filter (where event_type = 'error') / count(*), 4) as error_rate from e where ms >= (select max(ms) from e) - 432000000 group by user_id",
)


def _sql_functions(s: SparkSession, d: str) -> DataFrame:
    """The registered SQL functions over documents and pages, as an SQL user calls them."""
    REG.register(s)
    docs(s, d).createOrReplaceTempView("weft_documents")
    return s.sql("SELECT doc_id, weft_n_words(text) AS n_words, size(weft_sentences(text)) AS sentences, size(weft_tokens(text)) AS tokens, weft_content_hash(text) AS hash, round(weft_jaccard(weft_tokens(text), array('that', 'with')), 6) AS jaccard, (SELECT count(*) FROM weft_text_chunks(text, 1000)) AS chunks FROM weft_documents")


Q["sql_functions"] = (
    _sql_functions,
    rf"""with t as (select doc_id, text, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1) as tk from documents)
select doc_id, len({WORDS})::int as n_words, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::int as sentences, len(tk)::int as tokens, sha256(coalesce(text, '')) as hash, round(len(list_intersect(tk, ['that', 'with'])) / greatest(1, len(list_distinct(list_concat(tk, ['that', 'with'])))), 6) as jaccard, greatest(1, ceil(length(text) / 1000))::bigint as chunks from t""",
)
