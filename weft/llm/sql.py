"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: CRC-32 by its 256-entry table, which a recursive query makes from the polynomial.
_OP2 = """
with recursive steps as (
  select unnest(range(256)) as i, 0 as n, unnest(range(256)) as c
  union all
  select i, n + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where n < 8),
lut as (select list(c order by i) as l from steps where n = 8),
docs as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, coalesce(cast(doc_id as varchar), 'null') as k
  from documents),
sized as (
  select r, doc_id, k, length(h) // 2 + 8 as size,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
      lambda c, b: xor(c >> 8, l[xor(c & 255, b) + 1])), 4294967295) as text_crc32
  from docs, lut),
scored as (
  select r, s, -1.0 / ln((('0x' || substr(md5('|' || k || '|' || s), 1, 13))::bigint + 0.5) / 4503599627370496.0) as score
  from docs, range(25) g(s)),
best as (
  select r, first(s order by score desc, s) filter (where s < 24) as shard, first(s order by score desc, s) as grown_shard
  from scored group by r),
placed as (
  select doc_id, size, text_crc32, shard::int as shard, grown_shard::int as grown_shard
  from sized join best using (r))
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by substr(md5(coalesce(doc_id::varchar, 'null') || '|' || size || '|' || text_crc32), 1, 3), doc_id, size, text_crc32) - 1 as slot, grown_shard from placed
"""

_OP7 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
select * from ranked where rank <= 10
"""

_OP8 = f"""
with docs as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
toks as (
  select r, doc_id, source, t, list_filter(regexp_extract_all(t, '{_WORD}'), lambda w: w <> '') as w from docs),
grams as (
  select r, i, w[i:i + 7] as g from toks, unnest(range(1, len(w) - 6)) u(i)),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from grams) where n > 1),
covered as (
  select r, count(distinct i + j) as n from twice, range(8) k(j) group by r),
lines as (
  select r, sum(n - 1) as n from (
    select r, l, count(*) as n from (select r, unnest(string_split(t, chr(10))) as l from docs) where regexp_matches(l, '{_WORD}') group by r, l)
  group by r),
base as (
  select r, doc_id, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from toks left join lines using (r) left join covered using (r)),
ruled as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    n_symbols > 0.30::double * n_words or n_dup_lines > 0.10::double * n_words as gross,
    n_symbols > 0.10::double * n_words or n_dup_lines > 0.03::double * n_words or n_repeat_words > 0.15::double * n_words
      or word_chars / greatest(n_words, 1) < 2.0 or word_chars / greatest(n_words, 1) > 15.0 as soft
  from base),
hosts as (
  select source, count(*)::double as n, count(*) filter (where base_failed or gross or soft)::double as f from ruled group by source),
m as (
  select sum(f) / sum(n) as p, sum(n) / count(*) as mean,
    sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * count(*) / sum(n) as between_hosts
  from hosts),
prior as (
  select p, case when between_hosts > 1e-9 then least(mean, greatest(1.0, p * (1 - p) / between_hosts - 1)) else mean end as k from m),
rates as (
  select source, (f + p * k) / (n + k) as rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not gross and not (soft and rate >= 0.5) as kept
from ruled join rates on ruled.source is not distinct from rates.source
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licences() -> str:
    from . import licences as l

    norm = "lower(u)"
    for pattern, to in l.STEPS:
        norm = f"regexp_replace({norm}, {_quoted(pattern)}, {_quoted(to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in l.catalogue().items())
    rules = ", ".join(f"({i}, {_quoted(name)}, {_quoted(';' + ';'.join(seq) + ';')})" for i, (name, seq) in enumerate(l.RULES))
    ends = r"string_split(regexp_replace(%s, '([.!?;:])\s+', '\1' || chr(3), 'g'), chr(3))"
    return f"""
with docs as (
  select row_number() over () as r, doc_id, translate(regexp_replace(coalesce(text, ''), {_quoted(l.LABEL)}, '\\1', 'g'), chr(1) || chr(2), '  ') as t from documents),
flagged as (
  select * from docs where regexp_matches(t, {_quoted(l.KEYWORDS)})),
known(u, id) as (values {known}),
rules(n, name, seq) as (values {rules}),
lines as (
  select r, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as i from flagged),
units as (
  select r, i, l, unnest(s) as u, generate_subscripts(s, 1) as j from (select *, {ends % 'l'} as s from lines)),
settled as (
  select x.*, id from (select *, case when regexp_matches(u, {_quoted(l.KEYWORDS)}) then trim({norm}) end as v from units) x left join known on known.u = v),
runs as (
  select r, string_split(string_agg(case when regexp_matches(l, {_quoted(l.EMPTY_LINE)}) then chr(1) when id is not null then chr(1) || chr(2) || id || chr(1) else u end, ' ' order by i, j), chr(1)) as x from settled group by r),
run as (
  select r, unnest(x) as x, generate_subscripts(x, 1) as i from runs),
again as (
  select r, i, unnest(s) as u, generate_subscripts(s, 1) as j from (select r, i, {ends % 'x'} as s from run where not starts_with(x, chr(2)))),
found as (
  select r, i, 0 as j, substr(x, 2) as id from run where starts_with(x, chr(2))
  union all
  select r, i, j, id from (select r, i, j, trim({norm}) as u from again where regexp_matches(u, {_quoted(l.KEYWORDS)})) join known using (u)),
best as (
  select r, list(id order by i, j) as ids from found group by r),
hits as (
  select r, n, name, seq from best, rules where contains(';' || array_to_string(ids, ';') || ';', seq)),
names as (
  select r, name, min(n) as n from hits h
  where not exists (select 1 from hits g where g.r = h.r and g.seq <> h.seq and contains(g.seq, h.seq)) group by r, name),
listed as (
  select r, string_agg(name, ',' order by n) as licences, count(*) as k from names group by r)
select doc_id, coalesce(array_to_string(ids, ','), '') as sentence_ids, coalesce(licences, '') as licences, coalesce(k, 0)::int as n_licences
from docs left join best using (r) left join listed using (r)
"""


ORACLE = {"op2_rendezvous_shards": _OP2, "op7_exact_topk": _OP7, "op8_host_quality": _OP8, "op10_licence_rules": _licences()}
