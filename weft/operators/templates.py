"""Declarative extraction templates: a name, the pages it fits, and fields as ``css`` or ``css@attribute``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .extract import extract


@dataclass(frozen=True)
class Template:
    hosts: tuple[str, ...]
    fields: dict[str, str]


#: General templates for kinds of pages; site templates are registered by their users.
REGISTRY: dict[str, Template] = {
    "article": Template((), {"title": "article h1, h1", "author": "[rel=author], .author", "date": "time@datetime", "body": "article p"}),
    "product": Template((), {"name": "[itemprop=name], h1", "price": "[itemprop=price]@content", "currency": "[itemprop=priceCurrency]@content", "rating": "[itemprop=ratingValue]", "images": "[itemprop=image]@src"}),
    "listing": Template((), {"items": "li a, .item a", "links": "li a@href, .item a@href"}),
    "question": Template((), {"title": "h1", "question": ".question .body, .question", "answers": ".answer .body, .answer", "tags": ".tag"}),
    "repository": Template((), {"name": "h1", "about": "meta[name=description]@content", "language": "[itemprop=programmingLanguage]", "topics": ".topic-tag"}),
    "profile": Template((), {"name": "h1, .name", "headline": ".headline", "location": ".location", "links": "a[rel=me]@href"}),
}


def register(name: str, hosts: tuple[str, ...], fields: dict[str, str]) -> None:
    REGISTRY[name] = Template(hosts, dict(fields))


def run(pages: DataFrame, name: str) -> DataFrame:
    """page_id, fields (JSON) and error of the pages of the template's hosts (of all pages where it names none)."""
    if name not in REGISTRY:
        raise ValueError(f"no template {name!r}; there are {', '.join(sorted(REGISTRY))}")
    t = REGISTRY[name]
    if t.hosts:
        host = urls.host(F.col("url"))
        pages = pages.where(F.greatest(*(urls.domain_matches(host, F.lit(h)) for h in t.hosts), F.lit(False)))
    return extract(pages, ("fields",), t.fields)
