"""Named queries: each is a function (spark, sf_dir) and, where SQL can say it, its DuckDB statement."""

from __future__ import annotations

from . import corpus, history, links, research, rules, search, site, streams, trees


def registry() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for module in (corpus, search, site, links, history, research, rules, trees, streams):
        out |= module.Q
    return out
