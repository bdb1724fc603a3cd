"""Regular-expression extraction from HTML as Column expressions: scripts and comments go before any tag is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import urls

_DEAD = r"(?is)<!--.*?-->|<(script|style|noscript|iframe|svg|template)\b[^>]*>.*?</\1\s*>"
_CHROME = r"(?is)<(nav|header|footer|aside)\b[^>]*>.*?</\1\s*>"
_BLOCK = r"(?i)</?(p|div|section|article|li|ul|ol|h[1-6]|tr|table|blockquote|pre|br|hr|main|form|dl|dt|dd|figure)\b[^>]*>"
#: Entities and their characters.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def decoded(s: Column) -> Column:
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


def collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def live(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, _DEAD, " ")


def _plain(fragment: Column) -> Column:
    return collapsed(decoded(F.regexp_replace(fragment, r"<[^>]*>", "")))


def text(html: Column, chrome: bool = False) -> Column:
    """Visible text in one line; navigation, header, footer and aside only if ``chrome``."""
    body = live(html) if chrome else F.regexp_replace(live(html), _CHROME, " ")
    return collapsed(decoded(F.regexp_replace(F.regexp_replace(body, r"(?is)<head\b.*?</head\s*>", " "), r"<[^>]*>", " ")))


def block_text(html: Column) -> Column:
    """Visible text with a line for each block; table cells are spaced."""
    body = F.regexp_replace(F.regexp_replace(live(html), r"(?is)<head\b.*?</head\s*>", " "), _CHROME, " ")
    body = F.regexp_replace(F.regexp_replace(body, r"\s+", " "), r"(?i)</?t[dh]\b[^>]*>", " ")
    flat = decoded(F.regexp_replace(F.regexp_replace(body, _BLOCK, "\n"), r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def _first(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(html, pattern, group)


def title(html: Column) -> Column:
    """Open Graph title, else <title>, else the first <h1>, else ''."""
    options = [meta(html, "og:title"), _plain(_first(live(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>")), _plain(_first(live(html), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"))]
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in one tag's text, '' if absent."""
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return decoded(F.regexp_replace(quoted, "^[\"']|[\"']$", ""))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name."""
    return F.regexp_extract_all(live(html), F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def meta(html: Column, name: str) -> Column:
    """Content of the first <meta> with that name or property."""
    fits = F.filter(tags(html, "meta"), lambda t: F.lower(F.coalesce(F.nullif(attribute(t, "name"), F.lit("")), attribute(t, "property"))) == name)
    return F.coalesce(attribute(F.get(fits, F.lit(0)), "content"), F.lit(""))


def description(html: Column) -> Column:
    return F.coalesce(F.nullif(meta(html, "description"), F.lit("")), meta(html, "og:description"))


def keywords(html: Column) -> Column:
    return F.filter(F.transform(F.split(meta(html, "keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")


def canonical(html: Column) -> Column:
    fits = F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    return F.coalesce(attribute(F.get(fits, F.lit(0)), "href"), F.lit(""))


def language(html: Column) -> Column:
    return F.lower(attribute(F.coalesce(F.get(tags(html, "html"), F.lit(0)), F.lit("")), "lang"))


def charset(html: Column) -> Column:
    """Declared in the first 1024 characters; utf-8 if not."""
    head = F.substring(html, 1, 1024)
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_-]+)""", 1), F.lit("")), F.lit("utf-8")))


def prefixed_meta(html: Column, prefix: str) -> Column:
    """Map of the properties that start with a prefix (og:, twitter:), the first of equals."""
    named = F.transform(tags(html, "meta"), lambda t: F.struct(F.coalesce(F.nullif(attribute(t, "property"), F.lit("")), attribute(t, "name")).alias("k"), attribute(t, "content").alias("v")))
    fits = F.filter(named, lambda e: e["k"].startswith(prefix))
    first = F.filter(fits, lambda e, i: ~F.exists(F.slice(fits, 1, i), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.substr(e["k"], F.lit(len(prefix) + 1), F.length(e["k"])).alias("k"), e["v"].alias("v"))))


def headings(html: Column) -> Column:
    """Array of (level, text)."""
    found = F.regexp_extract_all(live(html), F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.regexp_extract(h, r"(?i)<h([1-6])", 1).cast("int").alias("level"), _plain(h).alias("text")))


def images(html: Column) -> Column:
    """Array of (src, alt, title, width, height, loading, srcset) of images with a source."""
    made = F.transform(tags(html, "img"), lambda t: F.struct(*(attribute(t, a).alias(a) for a in ("src", "alt", "title", "width", "height", "loading", "srcset"))))
    return F.filter(made, lambda i: i["src"] != "")


def base(html: Column, url: Column) -> Column:
    own = attribute(F.coalesce(F.get(tags(html, "base"), F.lit(0)), F.lit("")), "href")
    return F.when(own != "", urls.resolve(own, url)).otherwise(url)


def anchors(html: Column) -> Column:
    """Array of (href, text, rel) of all anchors with a usable reference."""
    found = F.regexp_extract_all(live(html), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    made = F.transform(found, lambda a: _one(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), lambda tag: F.struct(F.trim(attribute(tag, "href")).alias("href"), _plain(a).alias("text"), attribute(tag, "rel").alias("rel"))))
    return F.filter(made, lambda a: (a["href"] != "") & ~a["href"].startswith("#") & ~F.lower(a["href"]).startswith("javascript:"))


def _one(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks that parse, as text."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())


def element_counts(html: Column, names: tuple[str, ...] = ("p", "a", "img", "h1", "h2", "li", "table", "form")) -> dict[str, Column]:
    return {f"n_{n}": F.regexp_count(live(html), F.lit(rf"(?i)<{n}\b")) for n in names}


def classify(html: Column, url: Column) -> Column:
    """Kind of page: forms, restricted, dynamic, media, documents, public."""
    ext = F.lower(F.substring_index(urls.path(url), ".", -1))
    return (
        F.when(F.regexp_count(html, F.lit(r"(?i)<form\b")) > 0, "forms")
        .when(F.contains(html, F.lit("login")) | F.contains(html, F.lit("password")), "restricted")
        .when(F.contains(html, F.lit("application/json")), "dynamic")
        .when(ext.isin(*L.MEDIA_FILES), "media")
        .when(ext.isin(*L.DOCUMENT_FILES), "documents")
        .otherwise("public")
    )


def site_section(path: Column) -> Column:
    out = None
    for name, parts in L.SECTIONS.items():
        test = F.greatest(*(F.contains(path, F.lit(p)) for p in parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


# fixed values: colours by name
COLOR_NAMES = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080",
    "gray": "#808080", "grey": "#808080", "silver": "#c0c0c0", "maroon": "#800000", "navy": "#000080", "teal": "#008080", "olive": "#808000", "lime": "#00ff00", "aqua": "#00ffff", "fuchsia": "#ff00ff",
}


def color(value: Column) -> Column:
    """#rrggbb of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba(), hsl(), hsla() and names; null for others."""
    v = F.lower(F.trim(value))
    digit = lambda i: F.repeat(F.substr(v, F.lit(i), F.lit(1)), F.lit(2))
    two = lambda x: F.lpad(F.lower(F.hex(F.least(F.lit(255), x))), 2, "0")
    channel = lambda i: two(F.regexp_extract(v, r"^rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)", i).try_cast("int"))
    hsl = r"^hsla?\(\s*(\d+(?:\.\d+)?)(?:deg)?[\s,]+(\d+(?:\.\d+)?)%[\s,]+(\d+(?:\.\d+)?)%"
    part = lambda i: F.regexp_extract(v, hsl, i).try_cast("double")

    def mixed(x: Column) -> Column:
        # a channel is l - s min(l, 1 - l) max(-1, min(k - 3, 9 - k, 1)) with k = (n + h / 30) mod 12
        reach = x["s"] * F.least(x["l"], 1 - x["l"])
        at = lambda n: _one((F.lit(float(n)) + x["h"] / 30) % 12, lambda k: two(F.round(255 * (x["l"] - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))).cast("int")))
        return F.concat(F.lit("#"), at(0), at(8), at(4))

    out = (
        F.when(v.rlike(r"^#[0-9a-f]{3,4}$"), F.concat(F.lit("#"), digit(2), digit(3), digit(4)))
        .when(v.rlike(r"^#[0-9a-f]{6}([0-9a-f]{2})?$"), F.substring(v, 1, 7))
        .when(v.rlike(r"^rgba?\(\s*\d+[\s,]+\d+[\s,]+\d+"), F.concat(F.lit("#"), channel(1), channel(2), channel(3)))
        .when(v.rlike(hsl), _one(F.struct(part(1).alias("h"), (part(2) / 100).alias("s"), (part(3) / 100).alias("l")), mixed))
    )
    for name, code in COLOR_NAMES.items():
        out = out.when(v == name, code)
    return out


SUSPICIOUS = {
    "sql": r"(?i)\b(union\s+select|select\s+.+\s+from|insert\s+into|drop\s+table|delete\s+from|or\s+1\s*=\s*1)\b",
    "script": r"(?i)<script|javascript:|on(error|load|click)\s*=",
    "traversal": r"\.\./|\.\.\\|%2e%2e",
    "command": r"[;&|`]\s*(cat|ls|rm|wget|curl|bash|sh)\b|\$\(",
}


def suspicious(text: Column) -> Column:
    """Names of the injection patterns that a string matches."""
    return F.filter(F.array(*(F.when(text.rlike(p), n) for n, p in SUSPICIOUS.items())), lambda x: x.isNotNull())
