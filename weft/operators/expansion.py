"""Query expansion on the driver: a query is one value, its variants an ordered list without repeats."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

from ..functions.lexicons import STEM_RULES

#: Small defaults; callers bring their own dictionaries.
SYNONYMS = {"guide": ["tutorial", "manual"], "fast": ["quick", "rapid"], "error": ["bug", "fault"], "price": ["cost"], "buy": ["purchase"], "learn": ["study"], "example": ["sample"]}
SPELLING = {"recieve": "receive", "seperate": "separate", "definately": "definitely", "occured": "occurred", "wich": "which", "teh": "the", "adress": "address"}
STOP = set("a an the and or of in on for to with is are".split())


def words(query: str) -> list[str]:
    return [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", query)) if w]


def stem(word: str) -> str:
    low = word.lower()
    for suffix, to, least in STEM_RULES:
        if len(low) >= least and low.endswith(suffix):
            return low[: -len(suffix)] + to
    return low


def by_synonyms(query: str, synonyms: dict[str, list[str]] = SYNONYMS) -> Iterator[str]:
    """Each word by each of its synonyms, then up to three mixes of the word and its first two."""
    own = words(query)
    options = [synonyms.get(w.lower(), []) for w in own]
    for i, alternatives in enumerate(options):
        for s in alternatives:
            yield " ".join([*own[:i], s, *own[i + 1 :]])
    if any(options):
        mixes = (" ".join(m) for m in itertools.product(*([w, *o[:2]] for w, o in zip(own, options))))
        yield from (m for m in itertools.islice(mixes, 3) if m != query)


def by_spelling(query: str, spelling: dict[str, str] = SPELLING) -> Iterator[str]:
    fixed = [spelling.get(w.lower(), w) for w in words(query)]
    if fixed != words(query):
        yield " ".join(fixed)


def by_stems(query: str) -> Iterator[str]:
    own = words(query)
    stems = [stem(w) for w in own]
    if " ".join(stems) != query:
        yield " ".join(stems)
    for i, (w, s) in enumerate(zip(own, stems)):
        if s != w.lower():
            yield " ".join([*own[:i], s, *own[i + 1 :]])


def by_phrases(query: str) -> Iterator[str]:
    own = words(query)
    if len(own) > 1:
        yield f'"{" ".join(own)}"'
        for n in range(len(own) - 1, 1, -1):
            for i in range(len(own) - n + 1):
                yield " ".join([*own[:i], f'"{" ".join(own[i : i + n])}"', *own[i + n :]])


def by_operators(query: str) -> Iterator[str]:
    own = [w for w in words(query) if w.lower() not in STOP]
    if len(own) > 1:
        yield " AND ".join(own)
        yield " OR ".join(own)
        if len(own) > 2:
            yield f"({' AND '.join(own[:2])}) OR ({' OR '.join(own[2:])})"
        else:
            yield f'"{" ".join(own)}"~5'


STEPS: dict[str, Callable[[str], Iterator[str]]] = {"synonyms": by_synonyms, "spelling": by_spelling, "stems": by_stems, "phrases": by_phrases, "operators": by_operators}


def expand(query: str, most: int = 5, steps: tuple[str, ...] = tuple(STEPS)) -> list[str]:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("a query is a non-empty string")
    every = itertools.chain([query.strip()], *(STEPS[s](query) for s in steps))
    return list(dict.fromkeys(v for v in every if v))[:most]


def suggestions(query: str) -> list[str]:
    return [f"how to {query}", f"what is {query}", f"best {query}", f"{query} tutorial", f"{query} examples"]
