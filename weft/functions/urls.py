"""URL scalars as Column expressions.  RFC 3986 groups by regular expression; no host resolution, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Path suffixes that name a file.
FILE_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "7z", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp3", "mp4", "avi", "mov", "wmv", "exe", "dmg", "pkg", "deb", "rpm"]


def _group(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL) & (_group(url, 2) != ""), F.lit(False))


def scheme(url: Column) -> Column:
    return F.when(is_valid(url), F.lower(_group(url, 1)))


def host(url: Column) -> Column:
    return F.when(is_valid(url), F.lower(_group(url, 2)))


def port(url: Column) -> Column:
    """Explicit port, '' where it is the scheme's default or absent."""
    p, s = _group(url, 3), F.lower(_group(url, 1))
    return F.when(((s == "http") & (p == "80")) | ((s == "https") & (p == "443")), "").otherwise(p)


def path(url: Column) -> Column:
    p = _group(url, 4)
    return F.when(is_valid(url), F.when(p == "", "/").otherwise(p))


def query(url: Column) -> Column:
    return F.when(is_valid(url), _group(url, 5))


def fragment(url: Column) -> Column:
    return F.when(is_valid(url), _group(url, 6))


def origin(url: Column) -> Column:
    p = port(url)
    return F.when(is_valid(url), F.concat(scheme(url), F.lit("://"), host(url), F.when(p != "", F.concat(F.lit(":"), p)).otherwise("")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.coalesce(F.size(segments(url)), F.lit(0))


def _trimmed(p: Column) -> Column:
    return F.when((p != "/") & p.endswith("/"), F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)


def _params(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def _name(p: Column) -> Column:
    return F.substring_index(p, "=", 1)


def _value(p: Column) -> Column:
    return F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")


def _pair(p: Column) -> Column:
    return F.concat(_name(p), F.lit("="), _value(p))


def _with_query(base: Column, params: Column) -> Column:
    return F.concat(base, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def normalize(url: Column) -> Column:
    """Graph form: lower host, no default port, no trailing slash, parameters sorted by name (stable), no fragment; null if invalid."""
    numbered = F.transform(_params(url), lambda p, i: F.struct(_name(p).alias("n"), i.alias("i"), _pair(p).alias("p")))
    params = F.transform(F.array_sort(numbered), lambda x: x["p"])
    return F.when(is_valid(url), _with_query(F.concat(origin(url), _trimmed(path(url))), params))


def normalize_or_same(url: Column) -> Column:
    return F.coalesce(normalize(url), url)


def normalize_for_dedup(url: Column) -> Column:
    """Result form: ``www.`` dropped, one value (the first) for each non-empty parameter, sorted by name; scheme and fragment stay."""
    seen = _params(url)
    first = F.filter(seen, lambda p, i: ~F.exists(F.slice(seen, 1, i), lambda q: _name(q) == _name(p)))
    kept = F.transform(F.array_sort(F.transform(F.filter(first, lambda p: F.trim(_value(p)) != ""), lambda p: F.struct(_name(p).alias("n"), _pair(p).alias("p")))), lambda x: x["p"])
    p = port(url)
    base = F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), F.when(p != "", F.concat(F.lit(":"), p)).otherwise(""), _trimmed(path(url)))
    frag = F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise("")
    fallback = F.regexp_replace(F.lower(url), r"^https?://(www\.)?", "")
    return F.when(url.isNull() | (url == ""), "").when(is_valid(url), F.concat(_with_query(base, kept), frag)).otherwise(fallback)


def without_query(url: Column) -> Column:
    frag = F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise("")
    return F.when(is_valid(url), F.concat(origin(url), path(url), frag)).otherwise(url)


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host(a) == host(b), F.lit(False))


def is_subdomain(url: Column, base: Column) -> Column:
    """The host is the base's host or ends with its labels."""
    return F.coalesce((host(url) == host(base)) | host(url).endswith(F.concat(F.lit("."), host(base))), F.lit(False))


def file_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


def is_file(url: Column) -> Column:
    return F.coalesce(F.lower(path(url)).rlike(rf"\.({'|'.join(FILE_EXTENSIONS)})$"), F.lit(False))


def path_pattern(url: Column) -> Column:
    """'/', '/a/', or '/a/b/...'."""
    s = segments(url)
    return F.when(F.size(s) == 0, "/").when(F.size(s) == 1, F.concat(F.lit("/"), s[0], F.lit("/"))).otherwise(F.concat(F.lit("/"), s[0], F.lit("/"), s[1], F.lit("/...")))


def title_from_path(url: Column) -> Column:
    """Decoded path with separators as spaces."""
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(path(url)), path(url)), r"[-_/]+", " "))


def bare_domain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", ""), r"^www\.|[/?#:].*$", "")


def domain_matches(found: Column, wanted: Column) -> Column:
    return (found == wanted) | found.endswith(F.concat(F.lit("."), wanted))


def base_parts(base: Column) -> Column:
    """What links on a page are resolved against: path, scheme and origin of its base."""
    return F.struct(path(base).alias("path"), scheme(base).alias("scheme"), origin(base).alias("origin"))


def resolve(href: Column, base: Column, parts: Column | None = None) -> Column:
    """Absolute form of a link on a page: absolute, protocol-relative, root-relative, query, or relative to the page's folder.

    ``parts`` are the page's ``base_parts`` where they are at hand.
    """

    def joined(b: Column) -> Column:
        folder = F.regexp_replace(b["path"], r"[^/]*$", "")
        relative = F.regexp_replace(F.regexp_replace(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")), r"/[^/]+/\.\./", "/"), r"/\./", "/")
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(b["origin"], href))
            .when(href.startswith("?"), F.concat(b["origin"], b["path"], href))
            .otherwise(F.concat(b["origin"], relative))
        )

    return joined(parts) if parts is not None else F.element_at(F.transform(F.array(base_parts(base)), joined), 1)


def hash16(url: Column) -> Column:
    """First sixteen hex digits of SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def humanize(url: Column) -> Column:
    """A label for a path: its last segment without extension, separators as spaces, first letter raised; 'Home' for the root."""
    last = F.element_at(segments(url), -1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), r"[-_]+", " "))
    label = F.when(bare.rlike(r"^\d+$"), F.concat(F.lit("Page "), bare)).otherwise(F.concat(F.upper(F.substr(bare, F.lit(1), F.lit(1))), F.substr(bare, F.lit(2), F.length(bare))))
    return F.when(F.size(segments(url)) == 0, "Home").otherwise(label)
