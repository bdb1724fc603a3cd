"""Named entities by rules: capitalised runs, titles, corporate and place cues, dates and money; no trained model."""

from __future__ import annotations

import itertools
import re

from . import lexicons as L

# fixed values: what an entity is trimmed of, abbreviations that keep their period, cues of organisations and places
_HEAD = re.compile(r"^[\s\"'‘’“”`(\[{<,;:!?«»–—-]+")
_TAIL = re.compile(r"[\s\"'‘’“”`)\]}>,;:!?«»–—-]+$")
_ABBREVIATION = re.compile(r"^(?:[A-Za-z]\.)+$|^(?:inc|corp|ltd|co|llc|jr|sr|st|mr|mrs|ms|dr|no|vs?)\.$", re.I)
_SUFFIX = r"(?:Inc|Corp|Corporation|Company|Co|Ltd|LLC|Group)"
_ORGANISATION = r"(?:Airlines?|Authority|Agency|Association|Bureau|Commission|Committee|Corporation|Company|Council|Court|Foundation|Group|Institute|Institution|Organi[sz]ation|Press|Society|Union|University)"
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|President|Senator|Judge)"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DATE = re.compile(rf"\b(?:{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?(?:,? \d{{4}})?|\d{{1,2}} {_MONTH}(?: \d{{4}})?|{_MONTH} \d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})\b")
_MONEY = re.compile(r"(?:[$€£¥]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|thousand|[mkb]n?))?\b|\b\d[\d,]*(?:\.\d+)?\s?(?:dollars|euros|pounds|USD|EUR|GBP)\b)")
_NAME = r"[A-Z][a-z]+(?:[-'’][A-Z]?[a-z]+)*"
_PERSON = re.compile(rf"\b{_TITLES}\.? (?:[A-Z]\. )*{_NAME}(?: (?:[A-Z]\. )*{_NAME})?")
_CORPORATE = re.compile(rf"\b[A-Z][\w&]*(?: [A-Z][\w&]*)*,? {_SUFFIX}\b\.?|\b[A-Z]\w*(?: (?:of|for|and|the|[A-Z]\w*))* {_ORGANISATION}\b(?: of(?: the)? [A-Z]\w*(?: [A-Z]\w*)*)?|\b{_ORGANISATION} of(?: the)? [A-Z]\w*(?: [A-Z]\w*)*")
_PLACE = re.compile(r"\b(?:in|at|near|from|to) ((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)*)(?=[\s,.;:!?)]|$)")
_PROPER = re.compile(r"\b[A-Z][a-zA-Z.]+(?:\s+[A-Z][a-zA-Z.]+)*")
_LETTERS, _CAPITALISED = re.compile(r"[A-Za-z]+"), re.compile(r"\b[A-Z][a-z]+\b")
_BEFORE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\"'‘’“”()[]"
_BEFORE_SUFFIX = re.compile(rf"\b(?=([A-Z]{{2,}}),?\s+{_SUFFIX}\.?(?:[^a-zA-Z]|$))")
_BRACKETED, _NAMED = re.compile(r"\(([A-Z]{2,})\)"), re.compile(rf"\b{_ORGANISATION}\b[^.]{{0,60}}\Z")
_STOP = frozenset(L.STOP_WORDS["en"]) | {"this", "these", "those", "they", "we", "he", "she", "his", "her", "its", "an", "by", "at", "from", "or", "but", "not", "if", "when", "then", "there"}
#: Most entities of the last kind, and how many of them come from capitalised runs alone.
OTHERS, SUPPLEMENT = 15, 10


def clean(raw: str) -> str:
    """Without quotes, brackets and marks at its ends; a final period stays with an abbreviation."""
    entity, before = raw.strip(), None
    while entity != before:
        before = entity
        entity = _TAIL.sub("", _HEAD.sub("", entity))
        if entity.endswith(".") and not _ABBREVIATION.match(entity.split()[-1]):
            entity = entity.rstrip(".")
    return entity


def distinct(entities: list[str]) -> list[str]:
    """The first of equals, case aside."""
    return list({e.lower(): e for e in reversed(entities)}.values())[::-1]


def is_stop_word(entity: str) -> bool:
    return " " not in entity and entity.lower() in _STOP


def is_case(entity: str) -> bool:
    """The name of a case at law."""
    return re.search(r"\s+vs?\.?\s+", entity, re.I) is not None


def words_of(text: str) -> tuple[set[str], set[str]]:
    """All runs of letters of a text, and its capitalised words that stand elsewhere than where a sentence starts."""
    inner = set()
    for m in _CAPITALISED.finditer(text):
        if m.group() not in inner:
            head = text[max(0, m.start() - 200) : m.start()].rstrip(_BEFORE)
            if head and head[-1] not in ".!?:":
                inner.add(m.group())
    return set(_LETTERS.findall(text)), inner


def is_sentence_initial(entity: str, text: str, words: tuple[set[str], set[str]] | None = None) -> bool:
    """One capitalised word that the text also has in small letters, or only where a sentence starts.  ``words``: what ``words_of`` gives."""
    if " " in entity:
        return False
    if entity.lower() in _STOP:
        return True
    if not re.fullmatch(r"[A-Z][a-z]+", entity):
        return False
    runs, inner = words or words_of(text)
    return entity.lower() in runs or entity not in inner


def organisation_acronyms(text: str) -> set[str]:
    """The acronyms that a text has before a corporate suffix or, in brackets, after the name that they stand for."""
    found = {m.group(1) for m in _BEFORE_SUFFIX.finditer(text)}
    return found | {m.group(1) for m in _BRACKETED.finditer(text) if _NAMED.search(text, max(0, m.start() - 90), m.start())}


def extract(text: str | None) -> dict:
    """people, places, organizations, dates, money, other, and a summary of their number and density."""
    text = text or ""
    kept = lambda found: distinct([e for e in map(clean, found) if len(e) > 1 and not is_stop_word(e) and not re.fullmatch(r"(?:inc|corp|ltd|co|llc)\.?", e, re.I)])
    organizations = kept(m.group() for m in _CORPORATE.finditer(text))
    people = kept(m.group() for m in _PERSON.finditer(text))
    places = [p for p in kept(m.group(1) for m in _PLACE.finditer(text)) if p.lower() not in {e.lower() for e in organizations + people} and not re.fullmatch(_MONTH, p)]
    dates, money = kept(m.group() for m in _DATE.finditer(text)), kept(m.group() for m in _MONEY.finditer(text))
    named = organisation_acronyms(text)
    acronyms = [a for a in distinct(re.findall(r"\b[A-Z]{2,}\b", text)) if a in named]
    organizations = distinct(organizations + acronyms)
    cases = [e for e in people + places + organizations if is_case(e)]
    people, places, organizations = ([e for e in found if not is_case(e)] for found in (people, places, organizations))
    known = {e.lower() for e in people + places + organizations + dates + money}
    held, words_ = "\0".join(known), words_of(text)
    inside = lambda n: n.lower() in held
    proper = [p for run in _PROPER.findall(text) for p in re.split(r"(?<=[a-z]\.)\s+(?=[A-Z])", run)]
    supplement = list(itertools.islice((n for n in distinct([clean(p) for p in proper]) if len(n) > 1 and not inside(n) and not is_sentence_initial(n, text, words_)), SUPPLEMENT))
    other = [e for e in distinct(cases + supplement)[:OTHERS] if e.lower() not in known]
    every = [*people, *places, *organizations, *dates, *money, *other]
    unique, words = {e.lower() for e in every}, len(re.split(r"\s+", text))
    return {"people": people, "places": places, "organizations": organizations, "dates": dates, "money": money, "other": other, "total": len(every), "unique": len(unique), "density": len(unique) / words}
