"""SQL of the queries whose results SQL can express."""

from __future__ import annotations

from .quality import BITS, LEAST_SPREAD, METRICS, MIN_WORDS, PRIOR, RULES
from .warc import BASE32

_WORD = r"[^\x20\x09-\x0D]+"

OP5 = f"""
with sized as (select doc_id, source, coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, ''))) as salt, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size from documents),
per as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 as k from sized group by source),
weighed as (select source, source_size, case k when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from per),
filling as (
  select *, row_number() over (order by cap / weight, source nulls last) as pos,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed
), common as (select min(pos) as pos from filling where level * weight <= cap),
targets as (
  select f.source, f.source_size, least(cast(f.cap as double), coalesce((select level from filling x, common c where x.pos = c.pos) * f.weight, cast(f.cap as double))) as target from filling f
), placed as (
  select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then cast(floor(t.target) as bigint) // t.source_size else 0 end as epochs,
    sum(s.size) over (partition by s.source order by md5('mix:' || s.salt), s.size rows unbounded preceding) - s.size as start
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - epochs * source_size - start)) as bigint) as taken from placed
"""

_LETTERS = " || ".join(f"substr('{BASE32}', cast((cast('0x' || substr(h, {10 * k + 1}, 10) as bigint) >> {s}) & 31 as int) + 1, 1)" for k in range(4) for s in range(35, -1, -5))
OP6 = f"""
with hashed as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
named as (select page_id, payload_bytes, {_LETTERS} as payload_digest, min(page_id) over (partition by h, payload_bytes) as first from hashed)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from named
"""

_VALUES = " union all ".join(f"select doc_id, lang, source, base_failed, '{m}' as metric, (1000 * {a}) // greatest({b}, 1) as x from stats" for m, (a, b) in METRICS.items())
_CASE = lambda i: "case metric " + " ".join(f"when '{m}' then {r[i]}" for m, r in RULES.items()) + " end"
_DROP = f"greatest(length(bin(x)) - {BITS}, 0)"


def _quantiles(name: str, keys: str) -> str:
    by = f"{keys}metric"
    at = lambda i: f"cast(min(bin) filter (where rn >= n * ({_CASE(i)})::double) as double)"
    return f"""{name} as (
  select {by}, max(n) as n, {at(0)} as lo, {at(1)} as hi
  from (select *, row_number() over (partition by {by} order by bin) as rn, count(*) over (partition by {by}) as n from bins) group by {by}
)"""


_DRAWN = ", ".join(f"(o.n * o.{c} + {PRIOR} * w.{c}) / (o.n + {PRIOR}) as {c}" for c in ("lo", "hi"))


OP9 = f"""
with words as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
windows as (
  select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from words where len(ws) > 2)
), twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from windows) where c > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (
  select doc_id, count(*) as n, count(*) - count(distinct line) as dups from (select doc_id, unnest(string_split(text, chr(10))) as line from words)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
), stats as (
  select w.doc_id, w.lang, w.source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, coalesce(l.dups, 0) as n_dup_lines, coalesce(l.n, 0) as n_lines, coalesce(c.n, 0) as n_repeat_words,
    len(ws) < {MIN_WORDS} or 100 * coalesce(c.n, 0) > 50 * len(ws) as base_failed
  from words w left join covered c on c.doc_id = w.doc_id left join lines l on l.doc_id = w.doc_id
), values_ as ({_VALUES}), bins as (select lang, source, metric, (x >> {_DROP}) << {_DROP} as bin from values_ where not base_failed),
{_quantiles("own", "lang, source, ")}, {_quantiles("tongue", "lang, ")}, {_quantiles("every", "")},
tongue_ as (
  select lang, metric, lo, hi, greatest(hi - lo, {LEAST_SPREAD} * wide) as spread from (select o.lang, o.metric, {_DRAWN}, w.hi - w.lo as wide from tongue o join every w on w.metric = o.metric)
), fences as (
  select lang, source, metric, case when {_CASE(4)} then lo - ({_CASE(2)})::double * spread - ({_CASE(3)})::double else -1 end as low, hi + ({_CASE(2)})::double * spread + ({_CASE(3)})::double as high
  from (select *, greatest(hi - lo, {LEAST_SPREAD} * wide) as spread from (
    select o.lang, o.source, o.metric, {_DRAWN}, w.spread as wide from own o join tongue_ w on w.metric = o.metric and w.lang is not distinct from o.lang
  ))
), judged as (
  select v.doc_id, bool_and(x between low and high) as inside
  from values_ v left join fences f on f.metric = v.metric and f.lang is not distinct from v.lang and f.source is not distinct from v.source group by v.doc_id
)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(inside, true) as kept from stats s join judged j on j.doc_id = s.doc_id
"""
