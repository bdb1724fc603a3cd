"""Text statistics, readability, quality, sentiment and language as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas compute again for each element what they use from outside."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Edge of an ASCII word; the engine's own \\b also sees other letters as word characters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def round_half_up(x: Column, digits: int = 2) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Words, counted without making them."""
    return F.regexp_count(text, F.lit(r"\S+"))


def n_spaced(text: Column) -> Column:
    """Pieces between white space, empty ones at the ends too."""
    return F.regexp_count(text, F.lit(r"\s+")) + 1


def n_solid(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, r"\s+", ""))


def n_sentences(text: Column) -> Column:
    """Size of ``sentences``."""
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(r"(?<=[.!?])\s+(?=\S)")) + 1)


def n_sentences_simple(text: Column) -> Column:
    """Size of ``sentences_simple``."""
    return F.regexp_count(text, F.lit(r"[^.!?\s][^.!?]*"))


def tokens(text: Column, longer_than: int = 1) -> Column:
    """Lower-case ASCII word tokens of more than ``longer_than`` characters."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > longer_than)


def sentences_simple(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s).rlike(r"\S"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def sentences_merged(text: Column) -> Column:
    """Sentences; a piece that ends in an abbreviation, an initial or a word with a period inside goes on in the next."""

    def ends(piece: Column) -> Column:
        last = F.element_at(F.split(F.regexp_replace(piece, r"[.!?]\s*$", ""), r"\s+"), -1)
        bare = F.regexp_replace(F.lower(last), "[^a-z]", "")
        return piece.rlike(r"[.!?]\s*$") & ~(bare.isin(*L.ABBREVIATIONS) | last.rlike(r"[A-Za-z0-9_]\.[A-Za-z0-9_]") | last.rlike(r"^[A-Z]\.$"))

    def add(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["open"] != "", F.concat(acc["open"], F.lit(" "), piece)).otherwise(piece)
        return F.struct(F.when(ends(joined), F.concat(acc["done"], F.array(F.trim(joined)))).otherwise(acc["done"]).alias("done"), F.when(ends(joined), "").otherwise(joined).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    out = F.aggregate(F.split(text, r"(?<=[.!?])\s+"), start, add, lambda a: F.when(F.trim(a["open"]) != "", F.concat(a["done"], F.array(F.trim(a["open"])))).otherwise(a["done"]))
    return F.filter(out, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(r"\S"))


def statistics(text: Column) -> dict[str, Column]:
    w = n_words(text)
    return {
        "characters": F.length(text),
        "characters_no_spaces": n_solid(text),
        "words": w,
        "sentences": n_sentences(text),
        "paragraphs": F.size(paragraphs(text)),
        "reading_minutes": F.ceil(w / 200),
    }


def syllables(word: Column) -> Column:
    """Vowel groups, one less for a final e, one at least; short words have one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - F.when(low.endswith("e"), 1).otherwise(0)))


def syllables_letters(word: Column) -> Column:
    """Vowel groups of the letters, a final e dropped before counting; one at least."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(word), "[^a-z]", ""), "e$", "")
    return F.greatest(F.lit(1), F.regexp_count(letters, F.lit("[aeiouy]+")))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def syllable_sum(text: Column) -> Column:
    """Sum of ``syllables`` over the words of a text, by a few scans of it and none of its words.

    Of words over three characters: their vowel groups, less one for each final e, and one for each word that this
    leaves with none, which has no vowel or only one group that ends in the final e.
    """

    def counted(low: Column) -> Column:
        long = F.regexp_replace(low, r"(?<!\S)\S{1,3}(?!\S)", "")
        short = _count(low, r"(?<!\S)\S{1,3}(?!\S)")
        return short + let(long, lambda t: _count(t, "[aeiouy]+") - _count(t, r"e(?!\S)") + (_count(t, r"\S+") - _count(t, r"[aeiouy]\S*")) + _count(t, r"(?<!\S)[^\saeiouy]*+[aeiouy]*(?<=e)(?!\S)"))

    return let(F.lower(text), counted)


def syllable_letters_sum(text: Column) -> Column:
    """Sum of ``syllables_letters`` over the words: all vowel groups, and one for each word without any."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z\s]+", ""), r"e(?!\S)", "")
    return let(letters, lambda t: _count(t, "[aeiouy]+") - _count(t, r"[aeiouy]\S*")) + n_words(text)


def flesch(words_per_sentence: Column, per_word: Column) -> Column:
    return F.lit(206.835) - 1.015 * words_per_sentence - 84.6 * per_word


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def measures(text: Column) -> Column:
    """What the forms of readability are made of, each counted once: words, sentences, marks, solid, syllables, letters."""
    return F.struct(n_words(text).alias("words"), n_sentences(text).alias("sentences"), n_sentences_simple(text).alias("marks"), n_solid(text).alias("solid"), syllable_sum(text).alias("syllables"), syllable_letters_sum(text).alias("letters"))


def readability(text: Column) -> Column:
    """Struct of four Flesch forms.

    ``syllables``: true sentences, counted syllables; not clamped, as its level needs.  ``letters``: sentence marks,
    syllables of letters; not clamped.  ``by_length``: characters of a word over 4.7 stand for its syllables; clamped.
    ``raw_length``: characters of a word as they are; kept for parity.
    """

    def forms(m: Column) -> Column:
        per, long = ratio(m["words"], m["marks"]), ratio(m["solid"], m["words"])
        return F.struct(
            flesch(ratio(m["words"], m["sentences"]), ratio(m["syllables"], m["words"])).alias("syllables"), flesch(per, ratio(m["letters"], m["words"])).alias("letters"),
            clamp(flesch(per, long / 4.7)).alias("by_length"), flesch(per, long).alias("raw_length"),
        )

    return let(measures(text), forms)


def flesch_by_syllables(text: Column) -> Column:
    return readability(text)["syllables"]


def flesch_by_letters(text: Column) -> Column:
    return readability(text)["letters"]


def flesch_by_length(text: Column) -> Column:
    return readability(text)["by_length"]


def flesch_raw_length(text: Column) -> Column:
    return readability(text)["raw_length"]


def readability_level(score: Column) -> Column:
    return F.when(score >= 90, "Very Easy").when(score >= 80, "Easy").when(score >= 70, "Fairly Easy").when(score >= 60, "Standard").when(score >= 50, "Fairly Difficult").when(score >= 30, "Difficult").otherwise("Very Difficult")


def research_readability(text: Column) -> Column:
    avg = (_count(text, " ") + 1) / (_count(text, "[.!?]") + 1)
    return F.when(text.isNull() | (text == ""), 0.5).when(avg < 15, 0.8).when(avg < 20, 0.6).otherwise(0.4)


def boilerplate(text: Column) -> Column:
    """Share of boilerplate phrases: min(1, 10 * frequency + 5 * share of characters)."""

    def share(low: Column) -> Column:
        hits, length = F.lit(0), F.lit(0)
        for phrase in L.BOILERPLATE:
            gone = F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))
            hits, length = hits + gone / len(phrase), length + gone
        return F.least(F.lit(1.0), 10 * ratio(hits, n_spaced(text)) + 5 * ratio(length, F.length(text)))

    return let(F.lower(text), share)


def quality(text: Column) -> Column:
    """Struct of score (100 less penalties), whether half of it is left (valid), and the reasons."""

    def judged(m: Column) -> Column:
        w, bp = m["words"], m["boilerplate"]
        per = ratio(w, m["marks"])
        ease = clamp(flesch(per, ratio(m["letters"], w)))
        rules = [
            (F.length(text) < 100, F.lit(30), "too short"),
            (F.length(text) > 50000, F.lit(10), "very long"),
            (w < 20, F.lit(25), "too few words"),
            (per < 5, F.lit(15), "very short sentences"),
            (per > 30, F.lit(10), "very long sentences"),
            (bp > 0.3, F.floor(bp * 50 + 0.5), "boilerplate"),
            (ease < 30, F.lit(10), "poor readability"),
        ]
        lost = F.lit(0)
        for test, penalty, _ in rules:
            lost = lost + F.when(test, penalty).otherwise(0)
        score = F.when(text == "", 0).otherwise(100 - lost)
        reasons = F.filter(F.array(*(F.when(test, reason) for test, _, reason in rules)), lambda r: r.isNotNull())
        return F.struct(F.greatest(F.lit(0), score).cast("int").alias("score"), (score >= 50).alias("valid"), F.array_join(reasons, "; ").alias("reasons"))

    counted = F.struct(n_words(text).alias("words"), n_sentences_simple(text).alias("marks"), syllable_letters_sum(text).alias("letters"), boilerplate(text).alias("boilerplate"))
    return let(counted, judged)


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII word characters: what stands between ASCII word edges."""
    return F.split(text, r"[^A-Za-z0-9_]+")


def _hits(toks: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(*lexicon)))


def sentiment(text: Column) -> Column:
    """Struct of polarity over all words, its label, and confidence by hits (form A)."""

    def judged(c: Column) -> Column:
        p, n, w = c["p"], c["n"], c["w"]
        polarity = ratio(p - n, w)
        return F.struct(
            round_half_up(polarity).alias("polarity"), round_half_up(ratio(p + n, w)).alias("subjectivity"),
            F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral").alias("label"),
            F.when(p + n == 0, 0.5).otherwise(round_half_up(F.least(F.lit(1.0), (p + n) / 10))).alias("confidence"),
            F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n)).alias("balance"),
        )

    toks = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: w != "")
    return let(let(toks, lambda t: F.struct(_hits(t, L.POSITIVE).alias("p"), _hits(t, L.NEGATIVE).alias("n"), F.size(t).alias("w"))), judged)


def emotions(text: Column) -> Column:
    """Array of (emotion, intensity) of the emotions found, strongest five first, equals in order of the lexicon."""

    def found(x: Column) -> Column:
        per, rows = F.greatest(n_spaced(x["low"]) / 100, F.lit(1)), []
        for i, (name, keys) in enumerate(L.EMOTIONS.items()):
            n = _hits(x["toks"], [k for k in keys if " " not in k])
            for k in keys:
                if " " in k:
                    n = n + F.when(F.contains(x["low"], F.lit(k)), _count(x["low"], rf"{EDGE}{k}{EDGE}")).otherwise(0)
            rows.append(F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), n.alias("n")))
        scored = F.transform(F.filter(F.array(*rows), lambda r: r["n"] > 0), lambda r: F.struct((-round_half_up(F.least(F.lit(1.0), r["n"] / per))).alias("s"), r["i"].alias("i"), r["name"].alias("name")))
        return F.transform(F.slice(F.array_sort(scored), 1, 5), lambda x: F.struct(x["name"].alias("emotion"), (-x["s"]).alias("intensity")))

    known = [k for keys in L.EMOTIONS.values() for k in keys if " " not in k]
    shared = lambda low: F.struct(low.alias("low"), F.filter(ascii_tokens(low), lambda t: t.isin(*known)).alias("toks"))
    return let(let(F.lower(text), shared), found)


def vocabulary(text: Column) -> Column:
    """Struct of unique_words, richness (unique of all) and diversity (met once of unique)."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) > 2)

    def counted(o: Column) -> Column:
        same = lambda x, i, step: F.coalesce(F.get(o, i + step) == x, F.lit(False))
        return F.struct(F.size(o).alias("n"), F.size(F.filter(o, lambda x, i: (i == 0) | ~same(x, i, -1))).alias("u"), F.size(F.filter(o, lambda x, i: ((i == 0) | ~same(x, i, -1)) & ~same(x, i, 1))).alias("once"))

    return let(let(F.sort_array(w), counted), lambda c: F.struct(c["u"].alias("unique_words"), round_half_up(ratio(c["u"], c["n"])).alias("richness"), round_half_up(ratio(c["once"], c["u"])).alias("diversity")))


def runs(items: Column) -> Column:
    """Array of (n, term) of the distinct items of an array, in order of the items."""

    def cut(o: Column) -> Column:
        starts = F.filter(F.transform(o, lambda x, i: F.when((i == 0) | (F.get(o, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(starts, lambda a: F.transform(a, lambda at, k: F.struct((F.coalesce(F.get(a, k + 1), F.size(o)) - at).alias("n"), F.get(o, at).alias("term"))))

    return let(F.sort_array(items), cut)


def language(text: Column) -> Column:
    """Struct of the language of the most stop words, the first of equals, and a confidence from their density.

    Words of the lists stand between ASCII word edges; those with other letters are searched one by one.
    """
    plain = {lang: [w for w in dict.fromkeys(ws) if w.isascii()] for lang, ws in L.STOP_WORDS.items()}

    def of_list(found: Column, listed: list[str]) -> Column:
        return F.aggregate(F.filter(found, lambda r: r["term"].isin(*listed)), F.lit(0), lambda a, r: a + r["n"])

    def hits(x: Column) -> Column:
        out = []
        for lang, ws in L.STOP_WORDS.items():
            n = of_list(x["runs"], plain[lang])
            for w in ws:
                if not w.isascii():
                    n = n + F.when(F.contains(x["low"], F.lit(w)), _count(x["low"], rf"{EDGE}{w}{EDGE}")).otherwise(0)
            out.append(n)
        return F.array(*out)

    def judged(h: Column) -> Column:
        top = F.array_max(h)
        name = F.element_at(F.array(*map(F.lit, L.STOP_WORDS)), F.array_position(h, top).cast("int"))
        confidence = F.least(F.lit(95), F.floor(top / F.greatest(n_words(text), F.lit(1)) * 250 + 0.5)).cast("int")
        return F.struct(F.when(top > 0, name).alias("language"), F.when(top > 0, confidence).alias("confidence"))

    every = list(dict.fromkeys(w for ws in plain.values() for w in ws))
    shared = lambda low: F.struct(low.alias("low"), runs(F.filter(ascii_tokens(low), lambda t: t.isin(*every))).alias("runs"))
    return let(let(let(F.lower(text), shared), hits), judged)


def script(text: Column) -> Column:
    """First East Asian script found, else the first right-to-left one, else 'latin'."""
    out = None
    for name, pattern in {**L.SCRIPTS_CJK, **L.SCRIPTS_RTL}.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("latin")


def is_rtl(text: Column) -> Column:
    return text.rlike("|".join(L.SCRIPTS_RTL.values()))


def currency_signs(text: Column) -> Column:
    return F.filter(F.array(*(F.when(F.greatest(*(F.contains(text, F.lit(s)) for s in signs)), symbol) for symbol, (signs, _) in L.CURRENCIES.items())), lambda x: x.isNotNull())


def phone_country(text: Column) -> Column:
    out = None
    for country, pattern in L.PHONES.items():
        out = F.when(text.rlike(pattern), country) if out is None else out.when(text.rlike(pattern), country)
    return out


def date_formats(text: Column) -> Column:
    return F.filter(F.array(*(F.when(text.rlike(p), c) for c, p in L.DATES.items())), lambda x: x.isNotNull())


def topic_category(text: Column) -> Column:
    toks, out = ascii_tokens(F.lower(text)), None
    for name, keys in L.TOPICS.items():
        test = F.arrays_overlap(toks, F.array(*map(F.lit, keys)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def keyword_kind(word: Column, otherwise: str = "general") -> Column:
    low, out = F.lower(word), None
    for name, keys in L.KEYWORD_KINDS.items():
        out = F.when(low.isin(*keys), name) if out is None else out.when(low.isin(*keys), name)
    return out.otherwise(otherwise)


def stem(word: Column) -> Column:
    """Lower-case stem by the first suffix rule that fits a word of its least length."""
    low, out = F.lower(word), None
    for suffix, to, least in L.STEM_RULES:
        test = low.endswith(suffix) & (F.length(low) >= least)
        made = F.concat(F.substr(low, F.lit(1), F.length(low) - len(suffix)), F.lit(to))
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(low)


def clean_lines(text: Column) -> Column:
    """Line ends unified, runs of spaces and of three or more line feeds shortened, each line trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.trim(t)


def truncated(text: Column, most: int) -> dict[str, Column]:
    return {"text": F.substring(text, 1, most), "truncated": F.length(text) > most}
