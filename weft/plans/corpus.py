"""Queries over documents: statistics, readability, quality, sentiment, language, summaries, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import similarity as S
from ..functions import text as T
from ..operators.fingerprints import with_simhash
from ..operators.summary import summarise
from ..operators.vectors import nearest
from ..sources.tables import OVERLAP_SQL, benchmark_overlap, spread, table



def X() -> Column:
    return F.col("text")


Q: dict[str, tuple] = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _select(cols):
    return lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in cols().items()))


def _fields(of):
    """The fields of one struct for each row: what they share is computed once."""
    return lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", of(X()).alias("x")).select("doc_id", "x.*")


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
SIMPLE = r"len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '\S')))"

Q["text_statistics"] = (
    _select(lambda: T.statistics(X())),
    rf"""select doc_id, length(text) as characters, length(regexp_replace(text, '\s', '', 'g')) as characters_no_spaces, len({WORDS}) as words, len({SENTENCES}) as sentences,
  len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))) as paragraphs, ceil(len({WORDS}) / 200)::bigint as reading_minutes from documents""",
)


def _readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", T.readability(X()).alias("x"), T.research_readability(X()).alias("research"))
    return rows.select("doc_id", T.round_half_up(T.clamp(F.col("x.syllables"))).alias("score"), T.readability_level(F.col("x.syllables")).alias("level"), *(T.round_half_up(F.col(f"x.{c}"), 4).alias(c) for c in ("letters", "by_length", "raw_length")), "research")


_GROUPS = "len(regexp_extract_all(%s, '[aeiouy]+'))"
Q["readability"] = (
    _readability,
    rf"""with w as (select doc_id, text, {WORDS} as ws, len({SENTENCES}) as ns, {SIMPLE} as nm, length(regexp_replace(text, '\s', '', 'g')) as nc from documents),
c as (select *, len(ws) as n,
  coalesce(list_sum(list_transform(ws, lambda w: case when length(w) <= 3 then 1 else greatest(1, {_GROUPS % 'lower(w)'} - case when lower(w) like '%e' then 1 else 0 end) end)), 0) as sa,
  coalesce(list_sum(list_transform(ws, lambda w: greatest(1, {_GROUPS % "regexp_replace(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'e$', '')"}))), 0) as sb from w),
f as (select *, 206.835::double - 1.015::double * (n / greatest(ns, 1)) - 84.6::double * (sa / greatest(n, 1)) as a,
  206.835::double - 1.015::double * (n / greatest(nm, 1)) - 84.6::double * (sb / greatest(n, 1)) as b,
  206.835::double - 1.015::double * (n / greatest(nm, 1)) - 84.6::double * ((nc / greatest(n, 1)) / 4.7::double) as l,
  206.835::double - 1.015::double * (n / greatest(nm, 1)) - 84.6::double * (nc / greatest(n, 1)) as d,
  len(string_split(text, ' ')) / greatest(len(string_split_regex(text, '[.!?]')), 1) as r from c)
select doc_id, floor(greatest(0, least(100, a)) * 100 + 0.5) / 100 as score,
  case when a >= 90 then 'Very Easy' when a >= 80 then 'Easy' when a >= 70 then 'Fairly Easy' when a >= 60 then 'Standard' when a >= 50 then 'Fairly Difficult' when a >= 30 then 'Difficult' else 'Very Difficult' end as level,
  floor(b * 10000 + 0.5) / 10000 as letters, floor(greatest(0, least(100, l)) * 10000 + 0.5) / 10000 as by_length, floor(d * 10000 + 0.5) / 10000 as raw_length,
  case when r < 15 then 0.8::double when r < 20 then 0.6::double else 0.4::double end as research from f""",
)

_BP_N = " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in L.BOILERPLATE)
_BP_L = " + ".join(f"{len(p)} * len(regexp_extract_all(lower(text), '{p}'))" for p in L.BOILERPLATE)
_BP = rf"least(1.0::double, 10 * (({_BP_N}) / greatest(len(string_split_regex(text, '\s+')), 1)) + 5 * (({_BP_L}) / greatest(length(text), 1)))"
Q["boilerplate_score"] = (_select(lambda: dict(score=F.round(T.boilerplate(X()), 6))),  f"select doc_id, round({_BP}, 6) as score from documents")
Q["content_quality"] = (
    _fields(T.quality),
    rf"""with w as (select doc_id, text, {WORDS} as ws, {SIMPLE} as nm, {_BP} as bp from documents),
c as (select *, len(ws) as n, len(ws) / greatest(nm, 1) as per, greatest(0, least(100, 206.835::double - 1.015::double * (len(ws) / greatest(nm, 1)) - 84.6::double *
  (coalesce(list_sum(list_transform(ws, lambda w: greatest(1, {_GROUPS % "regexp_replace(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'e$', '')"}))), 0) / greatest(len(ws), 1)))) as ease from w),
r as (select doc_id, text, [case when length(text) < 100 then struct_pack(p := 30, r := 'too short') end, case when length(text) > 50000 then struct_pack(p := 10, r := 'very long') end,
  case when n < 20 then struct_pack(p := 25, r := 'too few words') end, case when per < 5 then struct_pack(p := 15, r := 'very short sentences') end, case when per > 30 then struct_pack(p := 10, r := 'very long sentences') end,
  case when bp > 0.3 then struct_pack(p := floor(bp * 50 + 0.5)::int, r := 'boilerplate') end, case when ease < 30 then struct_pack(p := 10, r := 'poor readability') end] as l from c),
s as (select doc_id, case when text = '' then 0 else 100 - coalesce(list_sum(list_transform(list_filter(l, lambda x: x is not null), lambda x: x.p)), 0) end as score, list_transform(list_filter(l, lambda x: x is not null), lambda x: x.r) as rs from r)
select doc_id, greatest(0, score)::int as score, score >= 50 as valid, array_to_string(rs, '; ') as reasons from s""",
)


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


Q["sentiment"] = (
    _fields(T.sentiment),
    rf"""with t as (select doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: w <> '') as w from documents),
c as (select doc_id, greatest(len(w), 1) as n, len(list_filter(w, lambda x: x in ({_in(L.POSITIVE)}))) as p, len(list_filter(w, lambda x: x in ({_in(L.NEGATIVE)}))) as m from t)
select doc_id, floor((p - m) / n * 100 + 0.5) / 100 as polarity, floor((p + m) / n * 100 + 0.5) / 100 as subjectivity,
  case when (p - m) / n > 0.1::double then 'positive' when (p - m) / n < -0.1::double then 'negative' else 'neutral' end as label,
  case when p + m = 0 then 0.5::double else floor(least(1, (p + m) / 10) * 100 + 0.5) / 100 end as confidence, case when p + m = 0 then 0::double else (p - m) / (p + m) end as balance from c""",
)
_EMO = ", ".join(f"struct_pack(name := '{n}', i := {i}, n := " + " + ".join(rf"len(regexp_extract_all(lower(text), '\b{k}\b'))" for k in ks) + ")" for i, (n, ks) in enumerate(L.EMOTIONS.items()))
Q["emotions"] = (
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.emotions(X()), lambda e: F.format_string("%s:%.2f", e["emotion"], e["intensity"])), ",").alias("emotions")),
    rf"""with e as (select doc_id, greatest(len(string_split_regex(lower(text), '\s+')) / 100, 1) as per, unnest([{_EMO}]) as x from documents),
s as (select doc_id, x.name as name, x.i as i, floor(least(1, x.n / per) * 100 + 0.5) / 100 as v from e where x.n > 0),
k as (select *, row_number() over (partition by doc_id order by v desc, i) as nth from s)
select doc_id, coalesce(emotions, '') as emotions from documents left join (select doc_id, string_agg(name || ':' || printf('%.2f', v), ',' order by nth) as emotions from k where nth <= 5 group by doc_id) using (doc_id)""",
)
Q["vocabulary"] = (
    _fields(T.vocabulary),
    r"""with w as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 2) as w from documents),
c as (select doc_id, w, count(*) as u, sum(n) as t, count(*) filter (where n = 1) as h from (select doc_id, x, count(*) as n from (select doc_id, unnest(w) as x from w) group by all) join w using (doc_id) group by doc_id, w)
select doc_id, coalesce(u, 0)::int as unique_words, floor(coalesce(u, 0) / greatest(coalesce(t, 0), 1) * 100 + 0.5) / 100 as richness, floor(coalesce(h, 0) / greatest(coalesce(u, 0), 1) * 100 + 0.5) / 100 as diversity from documents left join c using (doc_id)""",
)
_LANG = ", ".join(rf"len(regexp_extract_all(text, '(?i)\b(?:{'|'.join(dict.fromkeys(ws))})\b')) as {lang}" for lang, ws in L.STOP_WORDS.items())
Q["language_id"] = (
    _fields(T.language),
    f"""with h as (select doc_id, len({WORDS}) as n, {_LANG} from documents), t as (select *, greatest({', '.join(L.STOP_WORDS)}) as top from h)
select doc_id, case when top = 0 then null {' '.join(f"when {x} = top then '{x}'" for x in L.STOP_WORDS)} end as language, case when top > 0 then least(95, floor(top / greatest(n, 1) * 250 + 0.5))::int end as confidence from t""",
)
Q["locale_signals"] = (
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", T.script(X()).alias("script"), T.is_rtl(X()).alias("rtl"), F.array_join(T.currency_signs(X()), "").alias("currencies"), T.phone_country(X()).alias("phone_country"), F.array_join(T.date_formats(X()), ",").alias("date_formats"), X().rlike(L.METRIC).alias("metric"), X().rlike(L.IMPERIAL).alias("imperial")),
    rf"""select doc_id, case {' '.join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in {**L.SCRIPTS_CJK, **L.SCRIPTS_RTL}.items())} else 'latin' end as script,
  regexp_matches(text, '{'|'.join(L.SCRIPTS_RTL.values())}') as rtl,
  array_to_string(list_filter([{', '.join("case when " + ' or '.join(f"contains(text, '{x}')" for x in signs) + f" then '{k}' end" for k, (signs, _) in L.CURRENCIES.items())}], lambda x: x is not null), '') as currencies,
  case {' '.join(f"when regexp_matches(text, '{p}') then '{c}'" for c, p in L.PHONES.items())} end as phone_country,
  array_to_string(list_filter([{', '.join(f"case when regexp_matches(text, '{p}') then '{c}' end" for c, p in L.DATES.items())}], lambda x: x is not null), ',') as date_formats,
  regexp_matches(text, '{L.METRIC}') as metric, regexp_matches(text, '{L.IMPERIAL}') as imperial from documents""",
)
Q["topic_category"] = (
    _select(lambda: dict(category=T.topic_category(X()))),     f"select doc_id, case {' '.join(chr(10) + f'''when regexp_matches(lower(text), '{chr(92)}b({'|'.join(k)}){chr(92)}b') then '{n}' ''' for n, k in L.TOPICS.items())} else 'general' end as category from documents",
)
Q["document_hashes"] = (
    _select(lambda: dict(md5=F.md5(X()), sha1=F.sha1(X()), content_hash=S.content_hash(X()))),     "select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(coalesce(text, '')) as content_hash from documents",
)


def keywords(text: Column, most: int = 10) -> Column:
    """The most frequent tokens with frequency over all (relevance) and over the most frequent (salience), best first."""

    def best(found: Column) -> Column:
        total, first = F.aggregate(found, F.lit(0), lambda a, r: a + r["n"]), F.array_max(found["n"])
        order = F.slice(F.array_sort(F.transform(found, lambda r: F.struct((-r["n"]).alias("s"), r["term"].alias("term")))), 1, most)
        return F.transform(order, lambda r: F.struct(r["term"].alias("term"), (-r["s"]).cast("long").alias("n"), F.round(-r["s"] / total, 6).alias("relevance"), F.round(-r["s"] / first, 6).alias("salience")))

    return T.let(T.runs(T.tokens(text, 3)), best)


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", keywords(X()).alias("k"))
    return rows.select("doc_id", F.posexplode("k").alias("p", "k")).select("doc_id", (F.col("p") + 1).alias("rank"), "k.*")


Q["keywords"] = (
    _keywords,
    r"""with t as (select doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 3)) as term from documents), c as (select doc_id, term, count(*) as n from t group by all)
select * from (select doc_id, row_number() over (partition by doc_id order by n desc, term)::int as rank, term, n, round(n / sum(n) over (partition by doc_id), 6) as relevance, round(n / max(n) over (partition by doc_id), 6) as salience from c) where rank <= 10""",
)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive summary: the best tenth of the sentences, by mean term salience and position, in text order."""
    return summarise(docs(spark, sf_dir)).where("n_sentences > 0").select("doc_id", "n_sentences", F.md5("summary").alias("summary_md5"))


Q["extractive_summary"] = (
    _summary,
    rf"""with l as (select doc_id, {SENTENCES} as s from documents),
s as (select doc_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as s, len(s) as n from l),
t as (select doc_id, pos, unnest(list_filter(string_split_regex(regexp_replace(lower(s), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: length(w) > 2 and w not in ({_in(L.STOP_WORDS['en'])}))) as w from s),
f as (select doc_id, w, count(*) as f from t group by all), g as (select doc_id, w, f / max(f) over (partition by doc_id) as f from f),
k as (select doc_id, pos, sum(g.f) as sum, count(*) as k from t join g using (doc_id, w) group by all),
r as (select doc_id, pos, s, n, round(coalesce(sum / k * case when k < 5 then 0.5::double else 1::double end, 0) + case when pos = 0 then 0.4::double when pos = 1 then 0.15::double when pos = 2 then 0.08::double when pos = n - 1 then 0.05::double else 0::double end, 9) as score from s left join k using (doc_id, pos)),
x as (select *, row_number() over (partition by doc_id order by score desc, pos) as rank from r)
select doc_id, count(*) as n_sentences, md5(string_agg(s, ' ' order by pos)) as summary_md5 from x where rank <= greatest(1, ceil(n * 0.1::double)) or n < 3 group by doc_id""",
)


def _best(scored: Column, most: int = 5) -> Column:
    """The highest of an array of (score, pos), earlier ones first of equals."""
    return F.slice(F.array_sort(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["pos"].alias("pos")))), 1, most)


def _top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.transform(T.sentences(X()), lambda s, i: T.let(F.trim(s), lambda t: F.when(F.length(t).between(40, 500), F.struct((F.length(t) * 0.5 + F.regexp_count(t, F.lit("[A-Z][a-z]+")) * 5).cast("double").alias("score"), i.alias("pos")))))
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(_best(F.filter(scored, lambda x: x.isNotNull()))).alias("rank", "x"))
    return rows.select("doc_id", (F.col("rank") + 1).alias("rank"), "x.pos", (-F.col("x.s")).alias("score"))


Q["top_sentences"] = (
    _top_sentences,
    rf"""with l as (select doc_id, {SENTENCES} as s from documents), s as (select doc_id, generate_subscripts(s, 1) - 1 as pos, trim(unnest(s)) as s from l),
r as (select doc_id, pos, (length(s) * 0.5::double + len(regexp_extract_all(s, '[A-Z][a-z]+')) * 5)::double as score from s where length(s) between 40 and 500)
select * from (select doc_id, row_number() over (partition by doc_id order by score desc, pos)::int as rank, pos::int as pos, score from r) where rank <= 5""",
)


def key_point_scores(sentences: Column) -> Column:
    """Score of each sentence by length, place, digits and cue words: (score, pos) of those over 1."""

    def score(s: Column, i: Column, n: Column) -> Column:
        w = T.n_spaced(F.lower(s))
        return (
            T.let(w, lambda w: F.when(w.between(10, 25), 2.0).when(w.between(6, 30), 1.0).otherwise(0.0)) + F.when((i < n * 0.2) | (i > n * 0.8), 1.0).otherwise(0.0)
            + F.when(s.rlike("[0-9]"), 0.5).otherwise(0.0) + F.when(s.rlike(rf"(?i){T.EDGE}(important|significant|key|main|primary|essential|critical){T.EDGE}"), 1.0).otherwise(0.0)
        )

    scored = T.let(sentences, lambda a: F.transform(a, lambda s, i: F.struct(score(s, i, F.size(a)).alias("score"), i.alias("pos"))))
    return F.filter(scored, lambda x: x["score"] > 1)


def _key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best key points of a document."""
    return docs(spark, sf_dir).select("doc_id", F.explode(_best(key_point_scores(T.sentences(X())))).alias("x")).select("doc_id", "x.pos", (-F.col("x.s")).alias("score"))


Q["key_points"] = (
    _key_points,
    rf"""with l as (select doc_id, {SENTENCES} as s from documents), s as (select doc_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as s, len(s) as n from l), w as (select *, len(string_split_regex(lower(s), '\s+')) as w from s),
r as (select doc_id, pos, (case when w between 10 and 25 then 2 when w between 6 and 30 then 1 else 0 end + case when pos < n * 0.2::double or pos > n * 0.8::double then 1 else 0 end)::double + case when regexp_matches(s, '[0-9]') then 0.5::double else 0::double end
  + case when regexp_matches(s, '(?i)\b(important|significant|key|main|primary|essential|critical)\b') then 1::double else 0::double end as score from w)
select doc_id, pos::int as pos, score from (select *, row_number() over (partition by doc_id order by score desc, pos) as rank from r where score > 1) where rank <= 5""",
)


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.md5(X()).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    return d.join(first, "h").select("doc_id", "keep_id", "copies", (F.col("doc_id") == F.col("keep_id")).alias("kept"))


Q["exact_duplicates"] = (_exact, "select doc_id, min(doc_id) over (partition by md5(text)) as keep_id, count(*) over (partition by md5(text)) as copies, doc_id = min(doc_id) over (partition by md5(text)) as kept from documents")


def _simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each whole text."""
    return with_simhash(docs(spark, sf_dir), F.lower(X()))


Q["simhash_snippets"] = (_simhash, None)


#: Documents that share eight-token runs with benchmark items, by the number of shared runs (an extension).
Q["benchmark_overlap"] = (benchmark_overlap, OVERLAP_SQL)


def _embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest five vectors by cosine of every fiftieth vector against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


Q["embedding_neighbours"] = (
    _embedding_neighbours,
    """select * from (select q.vec_id as q, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id)::int as rank from embeddings e join embeddings q on q.vec_id % 50 = 0 and e.vec_id <> q.vec_id) where rank <= 5""",
)
Q["turn_statistics"] = (
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.sum(T.n_words(X())).alias("words"), F.max_by(F.md5("text"), "turn").alias("last_md5")),
    f"select conv_id, count(*) as turns, count(distinct role) as roles, sum(len({WORDS}))::bigint as words, max_by(md5(text), turn) as last_md5 from conversations group by conv_id",
)
Q["sentence_counts"] = (lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.size(T.sentences_merged(X())).alias("n")), None)
