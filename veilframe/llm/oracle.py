"""DuckDB's SQL for the queries that SQL can express on small tables."""

from __future__ import annotations

_WORDS = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n from documents),
s as (select doc_id, unnest(range(0, greatest(n - 49, 0))) as i, h from b),
w as (select doc_id, i, substring(h, 2 * i + 1, 100) as x from s),
m as (select x, min(doc_id) as first from w group by x),
r as (select w.doc_id, w.i from w join m using (x) where m.first < w.doc_id),
c as (select distinct doc_id, i + k as p from r, (select unnest(range(0, 50)) as k)),
p as (select doc_id, unnest(range(0, n)) as p, h from b),
k as (select p.doc_id, string_agg(substring(p.h, 2 * p.p + 1, 2), '' order by p.p) as kept from p left join c using (doc_id, p) where c.doc_id is null group by p.doc_id),
t as (select doc_id, count(*) as n_removed, sum(case when not exists (select 1 from c as d where d.doc_id = c.doc_id and d.p = c.p - 1) then 1 else 0 end) as n_spans from c group by doc_id)
select b.doc_id, b.n as n_bytes, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, cast(coalesce(t.n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k.kept, ''))) as kept_sha256
from b left join t using (doc_id) left join k using (doc_id)
"""

OP5 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
i as (select item_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[a:a + least(len(w), 10) - 1], ' ') as x from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as a from i where len(w) > 0)),
dw as (select doc_id, a, m, array_to_string(w[a:a + m - 1], ' ') as x from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as a from d, (select distinct m from iw))),
h as (select doc_id, a, m, item_id from dw join iw using (m, x)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(a, a + m)) as p from h) group by doc_id),
f as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join f using (doc_id)
"""

OP7 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORDS}') as w from documents),
s as (select distinct doc_id, array_to_string(w[a:a + 3], ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) as a from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
j as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (select u, v from j join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 85 * (a.n + b.n - c)),
r as (select doc_id as u, doc_id as v from n union select r.u, e.v from r join e on e.u = r.v)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(m.c, d.doc_id) as component_id from d left join n using (doc_id) left join (select u as doc_id, min(v) as c from r group by u) m using (doc_id)
"""

OP8 = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
g as (select doc_id, a, w[a] || ' ' || w[a + 1] || ' ' || w[a + 2] as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as a from d)),
q as (select doc_id, a from (select *, count(*) over (partition by doc_id, x) as c from g) where c > 1),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([a, a + 1, a + 2]) as p from q) group by doc_id),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '{_WORDS}') group by doc_id),
a as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
coalesce(n_lines, 0) as n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as n_exclamations from d left join r using (doc_id) left join l using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_dup_lines > 5 * n_lines or 10 * n_capitals > 6 * word_chars or 10 * n_exclamations > 5 * n_words) as kept from a
"""

ORACLE_SQL = {"op3_suffix_dedup": OP3, "op5_decontamination": OP5, "op7_jaccard_join": OP7, "op8_quality_rules": OP8}
