"""Extraction for ten well-known sites: which addresses they fit, and where the fields of a page stand.

A field has alternatives, ``css`` or ``css@attribute``, of which the first that gives something counts; a name that
ends in [] takes all of the first alternative that has any.  Rows of a page (stories, answers) are a list of records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom

_OG = {"title": "meta[property='og:title']@content", "description": "meta[property='og:description']@content", "image": "meta[property='og:image']@content", "url": "meta[property='og:url']@content"}

# fixed values: addresses and selectors, by site and field
SITES: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = {
    "amazon-product": (
        r"amazon\.(com|co\.uk|de|fr|jp|ca|com\.au)",
        {
            "title": ("#productTitle",),
            "price": (".a-price .a-offscreen", "#priceblock_ourprice", "#priceblock_dealprice"),
            "currency": ("meta[itemprop='priceCurrency']@content",),
            "rating": ("#acrPopover .a-size-base",),
            "review_count": ("#acrCustomerReviewText",),
            "asin": ("input#ASIN", "input[name='ASIN']@value"),
            "brand": ("#bylineInfo",),
            "description": ("#productDescription p", "#feature-bullets"),
            "images[]": ("#altImages img.a-thumbnail-image@src",),
            "availability": ("#availability span",),
            "category_breadcrumb[]": ("#wayfinding-breadcrumbs_feature_div a",),
        },
    ),
    "linkedin-profile": (
        r"linkedin\.com/in/",
        {
            "name": ("h1", ".top-card-layout__title"),
            "headline": (".top-card-layout__headline", "h2"),
            "location": (".top-card-layout__first-subline", ".profile-info-subheader"),
            "about": (".core-section-container__content p", ".summary"),
            "connections": (".top-card__connections",),
            "current_company": (".top-card-layout__card-inner-full-width .top-card-link",),
        },
    ),
    "github-repo": (
        r"github\.com/[^/]+/[^/]+/?$",
        {
            "name": ("strong[itemprop='name'] a", ".repository-content h1"),
            "description": (_OG["description"], "p.f4.my-3"),
            "stars": ("#repo-stars-counter-star", "[aria-label*='stargazers']"),
            "forks": ("#repo-network-counter", "[aria-label*='forks']"),
            "watchers": (".octicon-eye + strong", "[aria-label*='watchers']"),
            "language": ("span[itemprop='programmingLanguage']", ".d-inline-flex[class*='language']"),
            "topics[]": ("a.topic-tag, a[href^='/topics/']",),
            "license": ("a[href*='blob/'][href*='LICENSE']", ".octicon-law ~ span"),
            "last_updated": ("relative-time@datetime",),
            "homepage": ("a[href][rel='noopener noreferrer']@href",),
            "open_issues": (".Counter[aria-label*='issue']",),
        },
    ),
    "youtube-video": (
        r"youtube\.com/watch",
        {
            "title": ("meta[name='title']@content", _OG["title"]),
            "channel": ("link[itemprop='name']@content", "#channel-name"),
            "channel_url": ("span[itemprop='author'] link[itemprop='url']@href",),
            "views": ("meta[itemprop='interactionCount']@content",),
            "published": ("meta[itemprop='uploadDate']@content", "meta[itemprop='datePublished']@content"),
            "description": (_OG["description"],),
            "thumbnail": (_OG["image"],),
            "duration": ("meta[itemprop='duration']@content",),
            "video_id": ("link[rel='canonical']@href",),
        },
    ),
    "tweet": (
        r"(twitter|x)\.com/[^/]+/status/",
        {"text": (_OG["description"],), "author": (_OG["title"],), "url": (_OG["url"], "link[rel='canonical']@href"), "image": (_OG["image"],)},
    ),
    "reddit-thread": (
        r"reddit\.com/r/[^/]+/comments/",
        {
            "title": (_OG["title"], "h1"),
            "subreddit": ("a[href*='/r/'][class*='subreddit']",),
            "score": ("[data-score]", "[itemprop='upvoteCount']@content"),
            "author": ("a[href*='/user/']",),
            "posted": ("time[datetime]@datetime",),
            "body": ("div[data-click-id='text'] p", _OG["description"]),
            "url": (_OG["url"],),
            "flair": ("[class*='flair']",),
        },
    ),
    "hacker-news-front-page": (r"news\.ycombinator\.com(/news)?$", {}),
    "producthunt-launch": (
        r"producthunt\.com/posts/",
        {
            "name": (_OG["title"],),
            "tagline": (_OG["description"],),
            "image": (_OG["image"],),
            "url": (_OG["url"],),
            "votes": ("[data-test='vote-button'] span", "button[data-vote-button]"),
            "topics[]": ("a[href*='/topics/']",),
            "website": ("a[data-test='product-link']@href", "a[href][rel='noopener'][target='_blank']@href"),
        },
    ),
    "stackoverflow-question": (
        r"stackoverflow\.com/questions/",
        {
            "title": ("#question-header h1",),
            "body": (".question .s-prose",),
            "votes": (".question .js-vote-count", ".question [itemprop='upvoteCount']@content"),
            "views": (".js-view-count", "meta[name='twitter:data1']@content"),
            "tags[]": (".post-tag",),
            "author": (".question .user-details a",),
            "asked": (".question time@datetime",),
        },
    ),
    "npm-package": (
        r"npmjs\.com/package/",
        {
            "name": ("h1",),
            "version": ("h3[data-testid='package-version-number']", "[class*='version']"),
            "description": ("meta[name='description']@content", "p[class*='description']"),
            "license": ("span[class*='license']", "[data-cy='license']"),
            "weekly_downloads": ("span[class*='weekly-downloads']", "[data-cy='downloads']"),
            "homepage": ("a[href][class*='homepage']@href",),
            "repository": ("a[href*='github.com']@href",),
            "maintainers[]": ("a[href*='/~']",),
        },
    ),
}
#: Most images, stories and answers, and characters of an answer.
IMAGES, STORIES, ANSWERS, BODY = 8, 30, 5, 500


def _values(root: dom.Node, spec: str) -> list[str]:
    css, attribute = dom.split_attribute(spec)
    found = (n.attrs.get(attribute) if attribute else dom.squeeze(n.text()) for n in dom.select(root, css))
    return [v for v in found if v]


def _first(root: dom.Node, *specs: str) -> str | None:
    return next((v for s in specs for v in _values(root, s)[:1]), None)


def _stories(root: dom.Node) -> list[dict]:
    out = []
    for row in dom.select(root, "tr.athing"):
        mates = [c for c in row.parent.children if isinstance(c, dom.Node)]
        after = next((m for m in mates[mates.index(row) + 1 :] if m.tag == "tr"), dom.Node("tr"))
        score = _first(after, ".score")
        links = [x for x in _values(after, "a[href*='item']") if x not in _values(after, ".age a")]
        out.append({"id": row.attrs.get("id"), "title": _first(row, ".titleline > a"), "url": _first(row, ".titleline > a@href"), "site": _first(row, ".sitebit a"), "score": score and score.replace(" points", ""), "author": _first(after, ".hnuser"), "posted": _first(after, ".age a"), "comments": links[-1] if links else None})
    return out[:STORIES]


def _answers(root: dom.Node) -> list[dict]:
    found = dom.select(root, ".answer")
    return [{"votes": _first(a, "[itemprop='upvoteCount']@content", ".js-vote-count"), "accepted": "accepted-answer" in a.classes(), "body": (_first(a, ".s-prose") or "")[:BODY]} for a in found]


def extract(site: str, html: str | None) -> dict:
    """Fields of one page of a site; a field without a value is null, a list empty."""
    root = dom.parse(html)
    out: dict = {}
    for name, specs in SITES[site][1].items():
        if name.endswith("[]"):
            out[name[:-2]] = next((v for s in specs if (v := _values(root, s))), [])
        else:
            out[name] = _first(root, *specs)
    if site == "amazon-product":
        out["images"] = out["images"][:IMAGES]
    elif site == "youtube-video":
        out["video_id"] = next(iter(parse_qs(urlsplit(out["video_id"] or "").query).get("v", [])), None)
    elif site == "reddit-thread" and not out["subreddit"]:
        m = re.search(r"r/([^•]+)", _first(root, "title") or "")
        out["subreddit"] = m[1].strip() if m else None
    elif site == "hacker-news-front-page":
        out["stories"] = _stories(root)
    elif site == "stackoverflow-question":
        answers = _answers(root)
        out |= {"answers": answers[:ANSWERS], "answered": any(a["accepted"] for a in answers)}
    elif site == "npm-package":
        data = next((d for d in dom.json_ld(root) if isinstance(d, dict)), {})
        out["name"], out["license"] = out["name"] or data.get("name"), out["license"] or data.get("license")
        out["install_command"] = f"npm install {data.get('name') or out['name'] or ''}".strip()
    return out


def site_of(url: str) -> str | None:
    """The site whose addresses a URL fits."""
    return next((s for s, (pattern, _) in SITES.items() if re.search(pattern, url or "", re.I)), None)


def run_sites(pages: DataFrame, site: str | None = None, page_id: str = "page_id") -> DataFrame:
    """page_id, site, fields (JSON) and error, in Arrow batches: of the pages whose addresses fit a site, or of all as pages of ``site``."""
    if site is not None and site not in SITES:
        raise ValueError(f"no site {site!r}; there are {', '.join(SITES)}")
    kind = pages.schema[page_id].dataType.simpleString()
    known = pages if site else pages.where(F.col("url").rlike("(?i)" + "|".join(f"(?:{p})" for p, _ in SITES.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, made, errors = [site or site_of(u) for u in batch.column(1).to_pylist()], [], []
            for name, source in zip(names, batch.column(2).to_pylist()):
                try:
                    made.append(json.dumps(extract(name, source), ensure_ascii=False))
                    errors.append(None)
                except Exception as e:  # a page that breaks the parser keeps its row
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(made, pa.string()), pa.array(errors, pa.string())], [page_id, "site", "fields", "error"])

    return known.select(page_id, "url", "html").mapInArrow(run, f"`{page_id}` {kind}, site string, fields string, error string")
