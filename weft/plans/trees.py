"""Tree-based extraction queries over pages; tests hold them against hand-written pages."""

from __future__ import annotations

from ..operators import sites, templates
from ..operators.extract import extract
from ..sources.tables import spread, table

Q: dict[str, tuple] = {
    "page_markdown": (lambda s, d: extract(spread(table(s, d, "pages")), ("markdown", "method", "confidence")), None),
    "page_formats": (lambda s, d: extract(spread(table(s, d, "pages")), ("text", "formatted", "main_text", "json_ld", "schema", "clean", "microdata", "rdfa")), None),
    "page_fields": (lambda s, d: extract(spread(table(s, d, "pages")), ("fields", "structured"), {"title": "h1", "links": "nav a@href", "first": "article > p:first-child"}, {"properties": {"title": {"type": "string"}, "description": {"type": "string"}}, "required": ["title"]}), None),
    "page_template": (lambda s, d: templates.run(spread(table(s, d, "pages")), "article"), None),
    "site_fields": (lambda s, d: sites.run_sites(spread(table(s, d, "pages")), "stackoverflow-question"), None),
}
