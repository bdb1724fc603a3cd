"""Surrogates for personal data: keyed, format-preserving, bijective replacements in DataFrame functions only.

Every entity has a canonical form (an address in small letters, the digits of a number, the small letters of a name)
that passes through a keyed Feistel network whose rounds add to each character within its own alphabet (digit, vowel,
consonant, script).  The result is laid over the mention, so length, punctuation, case and script stay, equal entities
get equal surrogates, and unequal entities of one format cannot meet.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, make_room, materialize

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _accented(first: int, last: int, vowels: bool) -> str:
    """The accented small Latin letters of a block that have one capital, by whether a vowel carries the accent."""
    small = [chr(c) for c in range(first, last) if chr(c).upper().lower() == chr(c) != chr(c).upper() and len(chr(c).upper()) == 1]
    return "".join(c for c in small if (unicodedata.normalize("NFD", c)[0] in "aeiouæøœ") == vowels)


#: Alphabets of names in small letters: Latin, Greek, Cyrillic, Armenian.
NAME_ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", *(_accented(a, b, v) for a, b in ((0xE0, 0x180), (0x1E00, 0x1F00)) for v in (True, False)),
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "ђѓєѕіїјљњћќўџґ", "".join(map(chr, range(0x561, 0x587))),
)
#: First and last code point of the letters of scripts without case, each an alphabet of its own.
NAME_RANGES = (
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x671, 0x6D3), (0x905, 0x939), (0x985, 0x9A8), (0xB85, 0xBB9), (0xE01, 0xE2E), (0x10D0, 0x10F0),
    (0x1200, 0x1248), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)

#: Forms of address by gender.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "г-н", "Pan", "Κύριος", "Signor")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "г-жа", "Pani", "Κυρία", "Signora")
OPEN_TITLES = ("Dr", "Prof")
#: Given names that are exchanged among themselves, by script and gender.
GIVEN = {
    "male": ("james", "john", "robert", "michael", "david", "thomas", "peter", "paul", "hans", "karl", "pierre", "jean", "carlos", "juan", "luis", "miguel"),
    "female": ("mary", "anna", "linda", "susan", "laura", "emma", "julia", "sarah", "greta", "heidi", "marie", "claire", "carmen", "elena", "lucia", "sofia"),
    "male_cyrillic": ("иван", "пётр", "алексей", "сергей", "дмитрий", "николай", "андрей", "павел"),
    "female_cyrillic": ("анна", "мария", "ольга", "елена", "татьяна", "наталья", "ирина", "светлана"),
}

_TITLE = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES), key=len, reverse=True))
#: A word of a name; an apostrophe or hyphen belongs to it if two letters follow, so a possessive ending does not.
_WORD = r"(?:\p{Lu}(?:[\p{L}\p{M}]|['’-](?=\p{L}{2})){1,30}|\p{Lo}{2,20})"
_INITIAL = r"\p{Lu}\."
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Country calling codes; all others have three digits.
_CODE = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(0\))?\d(?:[ .-]?\d{2}){4}(?!\d)",
    r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\w.-])\d{3}([. -])\d{3}\1\d{4}(?![\w-]|[ .]\d)",
    r"(?<![\w.+-])0\d(?:([ .-])\d{2})(?:\2\d{2}){3}(?![\w-]|[ .]\d)",
    r"(?<![\w.+-])0\d{2,4}[/-]\d{5,8}(?![\w-])",
)
#: Type, pattern as one alternative of the scan, and the pattern that tells the type of a whole match.
PATTERNS = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", r"@"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])", r"^(AKIA|gh[pousr]_|sk-)"),
    ("hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}+(?![A-Za-z0-9])", r"^(?=.*[a-fA-F])[0-9a-fA-F]{32,}$"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}\d{2}"),
    ("phone", "|".join(_PHONE), r"^\+|^\(|^\d{3}([. -])\d{3}\1\d{4}$|^0\d(?:[ .-]\d{2}){4}$|^0\d{2,4}[/-]\d{5,8}$"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", r"^\d{3}-\d{2}-\d{4}$"),
    ("ip", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)", r"^\d+\.\d+\.\d+\.\d+$"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", r"^[\d -]+$"),
    ("name", rf"(?<![\p{{L}}])(?:{_TITLE})\.? (?:{_INITIAL} ?){{0,3}}{_WORD}(?: {_INITIAL}){{0,2}}(?: {_WORD})?", r"^\p{L}"),
]
SCAN = "|".join(p for _, p, _ in PATTERNS)
#: Texts without any of these hold no entity; a scan for single characters is quicker than the patterns.
MAYBE = rf"[0-9@]|(?:{_TITLE})\.? [\p{{Lu}}\p{{Lo}}]"
_PIECE = r"\p{L}(?:[\p{L}\p{M}]|['’-](?=\p{L}{2}))*\.?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, as expressions in lambdas are not shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _plain(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def _number(digest: Column, i: Column, digits: int = 4) -> Column:
    return F.conv(F.substr(digest, (i * 2) % 60 + 1, F.lit(digits)), 16, 10).cast("int")


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _table(strings: tuple[str, ...]) -> Column:
    """Alphabets as one string, with the first place and the size of its alphabet for each character, four digits each."""
    first = [sum(map(len, strings[:k])) + 1 for k in range(len(strings))]
    places = "".join(f"{f:04}" * len(x) for f, x in zip(first, strings))
    return F.struct(F.lit("".join(strings)).alias("all"), F.lit(places).alias("first"), F.lit("".join(f"{len(x):04}" * len(x) for x in strings)).alias("size"))


def alphabets(kind: Column) -> Column:
    return (
        F.when(kind.isin("phone", "ssn", "card"), _table((DIGITS,))).when(kind == "email", _table((DIGITS, LOWER))).when(kind == "hex", _table((HEX,)))
        .when(kind == "key", _table((DIGITS, LOWER, UPPER))).when(kind == "iban", _table((DIGITS, UPPER))).otherwise(_table(NAME_ALPHABETS))
    )


def moved(c: Column, by: Column, table: Column) -> Column:
    """A character moved within its alphabet; one of no alphabet stays."""
    entry = lambda name, p: F.substr(table[name], p * 4 - 3, F.lit(4)).cast("int")
    listed = lambda p: let(entry("first", p), lambda a: F.substr(table["all"], a + (p - a + by) % entry("size", p), F.lit(1)))
    code, ranged = F.ascii(c), None
    for a, b in NAME_RANGES:
        to = _char(F.lit(a) + (code - a + by) % (b - a + 1))
        ranged = F.when(code.between(a, b), to) if ranged is None else ranged.when(code.between(a, b), to)
    return let(F.instr(table["all"], c), lambda p: F.when(p > 0, listed(p)).when(code < NAME_RANGES[0][0], c).otherwise(ranged.otherwise(c)))


#: Rounds of the network; an even number, as each moves one half and exchanges the halves.
ROUNDS = 6


def cipher(s: Column, secret: str, label: Column, table: Column) -> Column:
    """A keyed bijection of the strings with the same alphabets at the same places."""

    def round_(x: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(secret), label, r.cast("string"), F.length(x["a"]).cast("string"), x["b"]), 256)
        return F.struct(x["b"].alias("a"), let(digest, lambda d: F.array_join(F.transform(_chars(x["a"]), lambda c, i: moved(c, _number(d, i), table)), "")).alias("b"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda x: F.concat(x["a"], x["b"]))


def luhn(digits: Column) -> Column:
    """The check digit that completes ``digits``."""
    at = lambda c, i: let(c.cast("int") * F.when((F.length(digits) - 1 - i) % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    total = F.aggregate(F.transform(_chars(digits), at), F.lit(0), lambda a, x: a + x)
    return (F.lit(10) - total % 10) % 10


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits (2 to 98) of an account number."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    add = lambda acc, c: let(value(c), lambda v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97))
    return F.lit(98) - F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), add)


def _ip(x: Column, secret: str, label: Column) -> Column:
    def round_(s: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(secret), label, r.cast("string"), F.array_join(s["b"], ".")), 256)
        return F.struct(s["b"].alias("a"), let(digest, lambda d: F.transform(s["a"], lambda o, i: ((o.cast("int") + _number(d, i, 2)) % 256).cast("string"))).alias("b"))

    start = let(F.split(x, r"\."), lambda o: F.struct(F.slice(o, 1, 2).alias("a"), F.slice(o, 3, 2).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.array_join(F.concat(s["a"], s["b"]), "."))


def exchanged(names: tuple[str, ...], secret: str, kind: str) -> list[str]:
    """For each name the next one in the order of their keyed digests: one cycle, so no name stays."""
    order = sorted(names, key=lambda n: hashlib.sha256(f"{secret}|{kind}|{n}".encode()).digest())
    return [order[(order.index(n) + 1) % len(order)] for n in names]


def listed_given(kind: Column, x: Column, secret: str) -> Column:
    """Another given name of the same script and gender for one in the lists, else null."""
    out = F.when(F.lit(False), x)
    for name, names in GIVEN.items():
        gender = name.split("_")[0]
        other = F.element_at(F.array(*map(F.lit, exchanged(names, secret, name))), F.array_position(F.array(*map(F.lit, names)), x).cast("int"))
        out = out.when(kind.isin("given", f"given {gender}") & x.isin(*names), other)
    return out


def made_of(kind: Column, x: Column, secret: str, tweak: Column) -> Column:
    """The surrogate of a canonical form; ``tweak`` is empty but where two entities would collide.

    An address is moved before and after its sign, a card but for its last digit, which is right if the card's was,
    an account but for its country, with check digits that are right if they were (00, 01 and 99 never are
    and stay), a key but for its prefix, all others whole.
    """
    rest = lambda n: F.substr(x, F.lit(n + 1), F.length(x))
    head = F.substr(x, F.lit(1), F.length(x) - 1)
    parts = F.when(kind == "email", F.array(F.substring_index(x, "@", 1), F.substring_index(x, "@", -1))).when(kind == "card", F.array(head)).when(kind == "iban", F.array(rest(4))).when(kind == "key", F.array(rest(4))).otherwise(F.array(x))
    group = F.when(kind.startswith("given"), "given").otherwise(kind)

    def whole(y: Column) -> Column:
        last = (luhn(y[0]) + F.right(x, F.lit(1)).cast("int") - luhn(head) + 10) % 10
        country, check = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(3), F.lit(2))
        right = F.pmod(check.cast("int") - iban_check(country, rest(4)) + iban_check(country, y[0]) - 2, F.lit(97)) + 2
        iban = F.concat(country, F.when(check.isin("00", "01", "99"), check).otherwise(F.lpad(right.cast("string"), 2, "0")), y[0])
        return F.when(kind == "email", F.concat(y[0], F.lit("@"), y[1], F.lit(".example"))).when(kind == "card", F.concat(y[0], last.cast("string"))).when(kind == "iban", iban).when(kind == "key", F.concat(F.substr(x, F.lit(1), F.lit(4)), y[0])).otherwise(y[0])

    table = alphabets(kind)
    ciphered = let(table, lambda t: let(F.transform(parts, lambda p, i: cipher(p, secret, F.concat_ws("|", group, i.cast("string"), tweak), t)), whole))
    initial = let(F.sha2(F.concat_ws("|", F.lit(secret), F.lit("initial")), 256), lambda d: moved(x, _number(d, F.lit(0)) % 4 + 1, table))
    other = F.when(kind == "ip", _ip(x, secret, F.concat_ws("|", kind, tweak))).when(kind == "initial", initial).otherwise(ciphered)
    return F.coalesce(F.when(kind.startswith("given") & (tweak == ""), listed_given(kind, x, secret)), other)


def _low(c: Column) -> Column:
    """A capital's small letter; what is no capital of one small letter stays."""
    return F.when(c == "ẞ", "ß").when((F.length(F.lower(c)) == 1) & (F.upper(F.lower(c)) == c), F.lower(c)).otherwise(c)


def _up(c: Column) -> Column:
    return F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)


def _small(s: Column) -> Column:
    return F.array_join(F.transform(_chars(s), _low), "")


def _cased(form: Column, low: Column) -> Column:
    """``low`` with capitals where ``form`` has them; beyond its end, capitals if it has no small letter."""
    capital = lambda i: F.when(i < F.length(form), let(F.substr(form, i + 1, F.lit(1)), lambda c: _low(c) != c)).otherwise(form == F.upper(form))
    return F.array_join(F.transform(_chars(low), lambda c, i: F.when(capital(i), _up(c)).otherwise(c)), "")


def _laid(form: Column, content: Column, small: bool = False) -> Column:
    """``content`` laid over the letters and digits of ``form``; with ``small``, in capitals where ``form`` has them."""

    def one(c: Column, i: Column) -> Column:
        got = F.substr(content, F.length(_plain(F.substr(form, F.lit(1), i + 1))), F.lit(1))
        if small:
            got = F.when(c.rlike("[A-Z]"), F.upper(got)).otherwise(got)
        return F.when(c.rlike("[0-9A-Za-z]"), got).otherwise(c)

    return F.array_join(F.transform(_chars(form), one), "")


def _phone_parts(m: Column) -> Column:
    """Country code, what follows it, and the trunk zero that its digits may start with."""
    code = F.regexp_extract(m, f"^{_CODE}", 0)
    return let(F.struct(code.alias("code"), F.substr(m, F.length(code) + 1, F.length(m)).alias("rest")), lambda x: F.struct(x["code"].alias("code"), x["rest"].alias("rest"), F.when(_plain(x["rest"]).startswith("0"), "0").otherwise("").alias("trunk")))


def canonical(kind: Column, m: Column) -> Column:
    """What makes two mentions the same entity: case, separators, the code of a country and a trunk zero don't count."""
    phone = let(_phone_parts(m), lambda p: F.substr(_plain(p["rest"]), F.length(p["trunk"]) + 1, F.length(m)))
    return F.when(kind.isin("email", "hex"), F.lower(m)).when(kind == "phone", phone).when(kind.isin("card", "iban", "ssn"), _plain(m)).when(kind.isin("key", "ip"), m).otherwise(_small(m))


def name_words(m: Column) -> Column:
    """Array of (kind, word, low) of a titled name's parts: initials, given names, and the last word as family name."""
    title = F.regexp_extract(m, rf"^(?:{_TITLE})\.?(?= )", 0)
    bare = F.regexp_replace(title, r"\.", "")
    gender = F.when(bare.isin(*MALE_TITLES), "given male").when(bare.isin(*FEMALE_TITLES), "given female").otherwise("given")

    def kinds(x: Column) -> Column:
        initial = lambda w: w.rlike(r"^\p{Lu}\.$")
        last = F.size(F.filter(x["words"], lambda w: ~initial(w)))
        nth = lambda i: F.size(F.filter(F.slice(x["words"], 1, i + 1), lambda w: ~initial(w)))
        word = lambda w: F.regexp_replace(w, r"\.$", "")
        return F.transform(x["words"], lambda w, i: F.struct(F.when(initial(w), "initial").when(nth(i) == last, "family").otherwise(x["gender"]).alias("kind"), word(w).alias("word"), _small(word(w)).alias("low")))

    return let(F.struct(gender.alias("gender"), F.regexp_extract_all(F.substr(m, F.length(title) + 1, F.length(m)), F.lit(_PIECE), F.lit(0)).alias("words")), kinds)


def _name(m: Column, words: Column) -> Column:
    """A titled name with its made words in place."""
    title = F.regexp_extract(m, rf"^(?:{_TITLE})\.?(?= )", 0)
    rest = F.substr(m, F.length(title) + 1, F.length(m))
    dots = F.transform(F.regexp_extract_all(rest, F.lit(_PIECE), F.lit(0)), lambda w: F.when(w.endswith("."), ".").otherwise(""))
    return F.concat(title, F.array_join(F.zip_with(F.split(rest, _PIECE, -1), F.zip_with(words, dots, lambda w, d: F.concat(w, d)), lambda a, w: F.concat(F.coalesce(a, F.lit("")), F.coalesce(w, F.lit("")))), ""))


def _laid_over(kind: Column, m: Column, made: Column) -> Column:
    phone = let(_phone_parts(m), lambda p: F.concat(p["code"], _laid(p["rest"], F.concat(p["trunk"], made))))
    return F.when(kind.isin("email", "hex"), F.when(m == F.upper(m), F.upper(made)).otherwise(made)).when(kind == "phone", phone).when(kind.isin("card", "iban", "ssn"), _laid(m, made)).otherwise(made)


def kind_of(m: Column) -> Column:
    out = None
    for kind, _, test in PATTERNS:
        out = F.when(m.rlike(test), kind) if out is None else out.when(m.rlike(test), kind)
    return out


_SEGMENT = "array<struct<s: string, kind: string, made: string>>"


def _plain_segment(s: Column) -> Column:
    return F.struct(s.alias("s"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("made"))


def _mentions(part: Column, known: Column) -> Column:
    """Segments of what stands between entities: bare mentions of the words of names, as they are or in capitals."""

    def cut(x: Column) -> Column:
        made = lambda w: F.coalesce(F.get(F.filter(known, lambda k: k["word"] == w), F.lit(0))["made"], F.upper(F.get(F.filter(known, lambda k: F.upper(k["word"]) == w), F.lit(0))["made"]))
        hits = F.transform(F.regexp_extract_all(part, x, F.lit(0)), lambda w: F.struct(w.alias("s"), F.lit("name").alias("kind"), made(w).alias("made")))
        return F.flatten(F.zip_with(F.split(part, x, -1), hits, lambda a, h: F.when(h.isNull(), F.array(_plain_segment(a))).otherwise(F.array(_plain_segment(a), h))))

    words = F.array_distinct(F.flatten(F.transform(known, lambda k: F.array(k["word"], F.upper(k["word"])))))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(known) > 0, let(pattern, cut)).otherwise(F.array(_plain_segment(part)))


def cut_at_entities(docs: DataFrame, text: Column, name: str, secret: str, tweak: Callable[[Column, Column], Column]) -> DataFrame:
    """``docs`` with a column ``name``: the text cut at its entities (s, kind, made), null where there is none.

    Between entities kind and made are null.  Each step is a column of its own, as the analyser bounds the
    depth of one expression.
    """
    ms, es, made, known = fresh(docs.withColumn(name, F.lit(0)), "found", "typed", "made", "known")
    rows = docs.withColumn(ms, F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(SCAN), F.lit(0))))
    single = lambda k, m: F.array(F.struct(k.alias("kind"), m.alias("word"), canonical(k, m).alias("low")))
    typed = F.transform(ms, lambda m: let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("found"), F.when(k == "name", name_words(m)).otherwise(single(k, m)).alias("items"))))
    rows = rows.withColumn(es, F.when(F.size(ms) > 0, typed))
    own = lambda w: made_of(w["kind"], w["low"], secret, tweak(w["kind"], w["low"]))
    rows = rows.withColumn(made, F.transform(es, lambda e: F.transform(e["items"], own)))
    laid = lambda e, y: F.when(e["kind"] == "name", F.zip_with(e["items"], y, lambda w, x: _cased(w["word"], x))).otherwise(F.array(_laid_over(e["kind"], e["found"], y[0])))
    rows = rows.withColumn(made, F.zip_with(es, made, laid))
    words = F.flatten(F.zip_with(F.filter(es, lambda e: e["kind"] == "name"), F.filter(made, lambda y, i: F.get(es, i)["kind"] == "name"), lambda e, y: F.zip_with(e["items"], y, lambda w, x: F.struct(w["word"].alias("word"), w["kind"].alias("kind"), x.alias("made")))))
    rows = rows.withColumn(known, F.array_distinct(F.filter(words, lambda w: (w["kind"] != "initial") & (F.length(w["word"]) > 1))))
    whole = lambda e, y: F.struct(e["found"].alias("s"), e["kind"].alias("kind"), F.when(e["kind"] == "name", _name(e["found"], y)).otherwise(y[0]).alias("made"))
    done = F.zip_with(es, made, whole)
    parts = F.zip_with(F.split(text, SCAN, -1), done, lambda a, e: F.concat(_mentions(a, F.col(known)), F.when(e.isNull(), F.array().cast(_SEGMENT)).otherwise(F.array(e))))
    return rows.withColumn(name, F.when(F.size(es) > 0, F.flatten(parts))).drop(ms, es, made, known)


def joined(parts: Column) -> Column:
    """The text of segments with surrogates in place."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["made"], p["s"])), "")


def checked(kind: Column, found: Column) -> Column:
    """Array of (kind, entity) that a mention is checked as: itself, or the given and family names of a titled name."""
    words = F.transform(F.filter(name_words(found), lambda w: w["kind"] != "initial"), lambda w: F.struct(w["kind"].alias("kind"), w["low"].alias("entity")))
    titled = found.rlike(rf"^(?:{_TITLE})\.? ")
    return F.when(kind != "name", F.array(F.struct(kind.alias("kind"), canonical(kind, found).alias("entity")))).when(titled, words).otherwise(F.array().cast("array<struct<kind: string, entity: string>>"))


def collisions(rows: DataFrame, found: str = "entities") -> DataFrame:
    """Surrogates that stand for two or more entities, or for the entity itself: kind, made, n."""
    pairs = rows.select(F.explode(found).alias("e")).select(F.explode(F.arrays_zip(checked(F.col("e.kind"), F.col("e.found")).alias("a"), checked(F.col("e.kind"), F.col("e.made")).alias("b"))).alias("p"))
    pairs = pairs.select("p.a.kind", "p.a.entity", F.col("p.b.entity").alias("made")).distinct()
    return pairs.groupBy("kind", "made").agg(F.count("*").alias("n"), F.max(F.col("entity") == F.col("made")).alias("same")).where("n > 1 or same").drop("same")


#: Tweaks that are tried for an entity before it keeps its first surrogate.
TRIES = 12
#: Rows to mend up to this number are broadcast (some MB) to meet their documents; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def tweaked(known: DataFrame, secret: str) -> DataFrame | None:
    """kind, entity and tweak of the entities whose first surrogate will not do; None if all will.

    It will not do if it is the entity itself, is another entity's surrogate, or is an entity of the corpus
    (but for given names, which are exchanged among themselves).  A tweak is taken if its surrogate is
    none of these and nobody's first surrogate, so an entity that finds none keeps its own, which stays distinct.
    """
    base = materialize(known.withColumn("made", made_of(F.col("kind"), F.col("entity"), secret, F.lit(""))), "entities")
    originals = base.select("kind", F.col("entity").alias("made")).where("kind not like 'given%'")
    twice = base.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("entity").alias("least")).where("n > 1").select("kind", "made", "least")
    bad = base.where("made = entity").select("kind", "entity").unionByName(base.join(originals, ["kind", "made"], "left_semi").select("kind", "entity")).unionByName(base.join(twice, ["kind", "made"]).where("entity <> least").select("kind", "entity"))
    left = materialize(bad.distinct(), "open")
    done = None
    for t in range(1, TRIES + 1):
        if not left.take(1):
            break
        tried = left.withColumns({"tweak": F.lit(str(t)), "made": made_of(F.col("kind"), F.col("entity"), secret, F.lit(str(t)))}).where("made <> entity")
        tried = tried.join(originals, ["kind", "made"], "left_anti").join(base.select("kind", "made"), ["kind", "made"], "left_anti")
        if done is not None:
            tried = tried.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        good = materialize(tried.groupBy("kind", "made").agg(F.min(F.struct("entity", "tweak")).alias("x")).select("kind", "x.entity", "x.tweak", "made"), "tweaks")
        done = good if done is None else done.unionByName(good)
        left = materialize(left.join(good, ["kind", "entity"], "left_anti"), "open")
    return None if done is None else done.select("kind", "entity", "tweak")


def pseudonymise(docs: DataFrame, key: str = "weft", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and a column ``entities`` of (kind, found, made).

    Texts do not move: each row is cut at its entities and written once, the distinct entities of the corpus are
    checked against one another, and rows with an entity whose surrogate collides are made again with a tweak for
    that entity alone.  Later and earlier bare mentions of a titled name's words are replaced as the name is.

    * A null text stays null, an empty one empty, both with no entities.  Rows alike in text come out alike.  No
      rows give an empty result.  Other columns pass; one called ``entities`` becomes ``input_entities``.
    * A text of any length is one row.  Names need a title; letters outside the alphabets and single letters that
      no alphabet holds stay.
    """
    docs = make_room(docs, "entities")
    rid, parts, tweak = fresh(docs, "rid", "parts", "tweak")
    none = lambda kind, entity: F.lit("")
    rows = cut_at_entities(docs.withColumn(rid, F.monotonically_increasing_id()), F.col(text), parts, key, none)
    rows = materialize(rows.withColumn(text, F.when(F.col(parts).isNull(), F.col(text))), "pii")
    mentions = rows.select(F.col(rid).alias("rid"), F.explode(parts).alias("e")).where("e.kind is not null").select("rid", F.explode(checked(F.col("e.kind"), F.col("e.s"))).alias("c"))
    mentions = mentions.select("rid", "c.kind", "c.entity")
    exceptions = tweaked(mentions.select("kind", "entity").distinct(), key)
    if exceptions is not None:
        mend = mentions.join(exceptions, ["kind", "entity"]).groupBy("rid").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws("|", "kind", "entity"), "tweak")))).alias(tweak))
        mend = materialize(mend.withColumnRenamed("rid", rid), "mend")
        mend = F.broadcast(mend) if mend.count() <= BROADCAST_ROWS else mend
        lookup = lambda kind, entity: F.coalesce(F.element_at(F.col(tweak), F.concat_ws("|", kind, entity)), F.lit(""))
        (again,) = fresh(rows, "again")
        rows = cut_at_entities(rows.join(mend, rid, "left"), F.when(F.col(tweak).isNotNull(), F.array_join(F.col(parts)["s"], "")), again, key, lookup)
        rows = rows.withColumn(parts, F.coalesce(again, parts))
    found = F.transform(F.filter(parts, lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("found"), p["made"].alias("made")))
    rows = rows.withColumns({text: F.coalesce(text, joined(F.col(parts))), "entities": F.coalesce(found, F.array().cast("array<struct<kind: string, found: string, made: string>>"))})
    return rows.select(*(f"`{c}`" for c in docs.columns), "entities")
