"""Predicates and small rules over URLs, texts, responses and settings as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import urls

# fixed values: signs of blocking by region, paths that need a browser, words that mark research
GEO_BLOCKING = [r"(?i)not available in your country", r"(?i)access denied", r"(?i)geo.?block", r"(?i)region.?restrict", r"(?i)unavailable in your location", r"(?i)vpn.?detect"]
RENDERED = [r"/(app|spa|dashboard|admin)(/|$)", r"\.(js|jsx|ts|tsx)$"]
RESEARCH_WORDS = ["research", "study", "analysis", "academic", "scientific"]
ENGLISH_MARKERS = ["the ", "is ", "are ", "was ", "and ", "for ", "that ", "with ", "this ", "from "]
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy"]
# fixed values: variations of a topic by approach
VARIATIONS = {
    "academic": ["{} research", "{} study", "{} analysis", "{} academic", "{} scientific", "{} research paper", "{} peer reviewed", "{} explained"],
    "current_events": ["latest {}", "{} news", "recent {}", "{} update", "{} announcement"],
    "broad": ["{} review", "{} reviews", "{} comparison", "{} vs alternatives", "{} pricing", "best {}", "{} company"],
}
# fixed values: settings of a domain without rules
DOMAIN_DEFAULTS = {"max_depth": 5, "max_pages": 100, "concurrency": 10, "timeout_ms": 30000}


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def should_crawl(url: Column, include: list[str], exclude: list[str]) -> Column:
    """One of the include patterns fits, if there are any, and none of the exclude patterns; case counts."""
    wanted = any_of([url.rlike(p) for p in include]) if include else F.lit(True)
    return wanted & ~any_of([url.rlike(p) for p in exclude])


def is_relevant(text: Column, query: str) -> Column:
    """A word of the query over three letters is in the text; true where there is nothing to compare."""
    terms = [t for t in re.split(r"\s+", query.lower()) if len(t) > 3]
    low = F.lower(text)
    return F.when(text.isNull() | (text == "") | F.lit(query == ""), True).otherwise(any_of([F.contains(low, F.lit(t)) for t in terms]))


def needs_rendering(url: Column) -> Column:
    bare = F.substring_index(url, "#", 1)
    return any_of([bare.rlike(p) for p in RENDERED])


def geo_blocked(status: Column, body: Column) -> Column:
    return F.coalesce(status.isin(403, 451), F.lit(False)) | F.coalesce(any_of([body.rlike(p) for p in GEO_BLOCKING]), F.lit(False))


def preferred(kind: Column, age_months: Column, kinds: list[str], recent: bool = False) -> Column:
    """A source of a wanted kind and, if asked, of the last year; what is not known passes."""
    fits = F.lit(True) if not kinds or "any" in kinds else kind.isNull() | kind.isin(*kinds)
    return fits & (age_months.isNull() | (age_months <= 12)) if recent else fits


def age_months(published: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(published)) / (86400 * 30.44)


def query_score(query: Column, topic: Column) -> Column:
    """0.5 and 0.3 of the topic's words that the query has, 0.2 for a word of research, 0.1 for a fair length; 1 for the topic itself."""
    words, own = F.split(F.lower(topic), " "), F.split(F.lower(query), " ")
    overlap = F.size(F.filter(words, lambda w: F.array_contains(own, w))) / F.size(words)
    research = any_of([F.contains(F.lower(query), F.lit(w)) for w in RESEARCH_WORDS])
    return F.when(query == topic, 1.0).otherwise(0.5 + 0.3 * overlap + F.when(research, 0.2).otherwise(0.0) + F.when((F.length(query) > 10) & (F.length(query) < 100), 0.1).otherwise(0.0))


def variations(topic: Column, approach: str = "broad") -> Column:
    """The topic and its variations, as an array."""
    return F.array(topic, *(F.concat(*[F.lit(a) if a else topic for a in _around(v)]) for v in VARIATIONS[approach]))


def _around(pattern: str) -> list[str]:
    head, tail = pattern.split("{}")
    return [x for x in (head, None, tail) if x is None or x]


def looks_english(text: Column) -> Column:
    """Over 70 % Latin letters, and two of the ten markers."""
    low = F.lower(text)
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]+", "")) / F.greatest(T.n_solid(text), F.lit(1))
    hits = sum((F.contains(low, F.lit(m)).cast("int") for m in ENGLISH_MARKERS), F.lit(0))
    return (latin > 0.7) & (hits >= 2)


def language_confidence(text: Column) -> Column:
    return T.round_half_up(F.least(F.lit(1.0), 0.5 + F.length(text) / 500 * 0.5))


def extraction_confidence(n_fields: Column, valid: Column, n_errors: Column, learned: bool = False) -> Column:
    """0.6 or, if not valid, 0.4 (0.9 and 0.7 for a learned extractor), less 0.1 for each error, 0.3 at most; 0 without fields."""
    base = F.when(valid, 0.9 if learned else 0.6).otherwise(0.7 if learned else 0.4)
    return F.when(n_fields == 0, 0.0).otherwise(F.greatest(F.lit(0.0), T.round_half_up(base - F.least(F.lit(0.3), n_errors * 0.1))))


def line_value(content: Column, key: str, kind: str = "string") -> Column:
    """Value after the colon of the first line that names a key; underscores stand for spaces and hyphens."""
    pattern = "(?i)" + re.escape(key).replace("_", r"[\s_-]")
    line = F.get(F.filter(F.split(content, "\n"), lambda x: x.rlike(pattern)), F.lit(0))
    raw = F.nullif(F.trim(F.regexp_extract(line, r":\s*(.+)$", 1)), F.lit(""))
    if kind == "number":
        return F.regexp_extract(F.regexp_replace(raw, "[^0-9.-]", ""), r"^-?\d*\.?\d+", 0).try_cast("double")
    return raw.rlike("(?i)true|yes|1") if kind == "boolean" else raw


def summary_confidence(text: Column, summary: Column) -> Column:
    """0.5 of the words that both share of the fewer, 0.3 for a fair compression (half of it else), 0.2 for a fair length (0.14 else)."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 2)

    def score(x: Column) -> Column:
        s, t = F.array_distinct(x["s"]), F.array_distinct(x["t"])
        shared = F.size(F.array_intersect(s, t)) / F.greatest(F.least(F.size(s), F.size(t)), F.lit(1))
        ratio = F.length(summary) / F.length(text)
        whole = 0.5 * shared + 0.3 * F.when((ratio > 0.1) & (ratio < 0.8), 1.0).otherwise(0.5) + 0.2 * F.when(F.size(x["s"]).between(10, 200), 1.0).otherwise(0.7)
        return F.when((F.size(x["s"]) == 0) | (F.size(x["t"]) == 0), 0.0).otherwise(T.round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole))))

    return T.let(F.struct(words(summary).alias("s"), words(text).alias("t")), score)


def page_language(declared: Column, header: Column, found: Column) -> Column:
    """Struct of a page's language and confidence: declared by its element (0.3), by its header (0.25, which wins), found in its text.

    ``found`` has language and confidence in per cent; it counts 0.6 where nothing is declared, else 0.2.
    """
    said = F.coalesce(F.nullif(header, F.lit("")), F.nullif(declared, F.lit("")))
    base = F.when(F.coalesce(declared, F.lit("")) != "", 0.3).otherwise(0.0) + F.when(F.coalesce(header, F.lit("")) != "", 0.25).otherwise(0.0)
    more = F.when(found["language"].isNull(), 0.0).otherwise(found["confidence"] / 100 * F.when(said.isNull(), 0.6).otherwise(0.2))
    return F.struct(F.coalesce(said, found["language"]).alias("language"), (base + more).alias("confidence"))


def evidence_score(priority: Column, content: Column, query: str) -> Column:
    """1000 for a preferred source, and one for each word of the query over three letters that the content has."""
    hits = sum((F.contains(F.lower(content), F.lit(t)).cast("int") for t in re.split(r"\s+", query.lower()) if len(t) > 3), F.lit(0))
    return F.when(priority, 1000).otherwise(0) + hits


def sanitized_url(url: Column) -> Column:
    """Without credentials and fragment; null where it is no URL."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.when(urls.is_valid(url), bare)


def sanitized_string(text: Column, most: int = 10_000) -> Column:
    """Without control characters, markup and script calls, cut to ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), "<[^>]*>", "")
    return F.substring(F.trim(F.regexp_replace(t, "(?i)javascript:", "")), 1, most)


def api_type(path: Column) -> Column:
    low = F.lower(path)
    has = lambda *xs: any_of([F.contains(low, F.lit(x)) for x in xs])
    return F.when(has("graphql"), "graphql").when(has("swagger", "openapi"), "openapi").when(has("/rest", "/api"), "rest").when(has("rss", "feed"), "feed").otherwise("unknown")


def security_area(path: Column) -> Column:
    low = F.lower(path)
    has = lambda *xs: any_of([F.contains(low, F.lit(x)) for x in xs])
    return F.when(has("login", "signin", "auth"), "authentication").when(has("admin"), "administration").when(has("account", "profile"), "account").when(has("checkout", "payment"), "payment").otherwise("none")


def present_headers(headers: Column) -> Column:
    """Of a map of response headers, those that guard a page."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*SECURITY_HEADERS) & v.isNotNull())


def source_of(path: Column) -> Column:
    """How a document is to be read: as a page, a PDF, or a file, by its address."""
    return F.when(F.lower(F.regexp_replace(path, r"[?#].*$", "")).endswith(".pdf"), "pdf").when(path.rlike("^https?://"), "url").otherwise("file")


def keyed_lower(values: Column) -> Column:
    """A map with small keys, trimmed values and none that is null or empty."""
    trimmed = F.transform_values(F.transform_keys(values, lambda k, v: F.lower(F.trim(k))), lambda k, v: F.trim(v))
    return F.map_filter(trimmed, lambda k, v: v.isNotNull() & (v != ""))
