"""Check SQL (DuckDB) of the corpus queries."""

from __future__ import annotations

from .common import LOWER, UPPER

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with d as (select doc_id, {_ITEM_WORDS} as w from documents),
b as (select item_id, {_ITEM_WORDS} as w from benchmark),
r as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as c
      from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
dr as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as c
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from r))),
m as (select doc_id, i, n, item_id from dr join r using (n, c)),
h as (select doc_id, count(distinct p) as n_hit
      from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from m)) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as l
      from (select distinct doc_id, item_id::varchar as s from m) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

LINES = """
with l as (select doc_id, source, i, lines[i] as line, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
           from (select doc_id, source, lines, unnest(range(1, len(lines) + 1)) as i
                 from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
b as (select bare from (select distinct bare, source from l where bare <> '') group by bare having count(*) >= 5)
select doc_id, count(*) filter (where bare <> '')::bigint as n_lines, count(*) filter (where b.bare is not null)::bigint as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where b.bare is null), '')) as kept_sha256
from l left join b using (bare) group by doc_id
"""

EXACT = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))) + ")"


# DuckDB has no crc32: the table of its 256 steps comes from eight shifts of each byte, the checksum from a fold over bytes.
_CRC = """crc_table as (
  select list(list_reduce([b] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
  from (select unnest(range(256))::bigint as b)),
crc as (select id, xor(list_reduce([4294967295::bigint] || list_transform(string_split(id::varchar, ''), lambda x: ascii(x)::bigint),
                                   lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as c
        from ids, crc_table)"""

_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

# Levels are lists; ``up`` holds those of every language and, as language null of level kind 1, those over the subroots.
MANIFEST = f"""
with recursive ids as (select distinct doc_id as id from documents), {_CRC},
d as (select doc_id, lang, {_leaf("text")} as leaf, {_leaf(_LOWERED)} as lowered,
             row_number() over (partition by lang order by doc_id nulls first, {_leaf("text")}) - 1 as i
      from documents),
up as (select lang, 0 as level, list(leaf order by i) as l from d group by lang
       union all
       select lang, level + 1, list_transform(range((len(l) + 7) // 8), lambda k: sha256(array_to_string(l[8 * k + 1:8 * k + 8], '')))
       from up where len(l) > 1),
sub as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from up where len(l) = 1),
over as (select 0 as level, list(subroot order by i) as l from sub
         union all
         select level + 1, list_transform(range((len(l) + 7) // 8), lambda k: sha256(array_to_string(l[8 * k + 1:8 * k + 8], '')))
         from over where len(l) > 1),
steps as (select d.doc_id, d.leaf, sub.subroot, u.level as level, l, d.i // (8::bigint ** u.level)::bigint as i
          from d join up u on d.lang is not distinct from u.lang join sub on d.lang is not distinct from sub.lang where len(u.l) > 1
          union all
          select d.doc_id, d.leaf, sub.subroot, 1000 + o.level, l, sub.i // (8::bigint ** o.level)::bigint
          from d join sub on d.lang is not distinct from sub.lang, over o where len(o.l) > 1),
sides as (select doc_id, leaf, level, array_to_string(l[8 * (i // 8) + 1:i], '') as a, array_to_string(l[i + 2:8 * (i // 8) + 8], '') as b
          from steps),
path as (select doc_id, leaf, list({{'a': a, 'b': b}} order by level) as p, string_agg(a || b, '' order by level) as s
         from sides group by all),
walk as (select d.doc_id, d.lang, d.leaf, coalesce(p, []) as p, coalesce(s, '') as s, 1 as k,
                case when c % 3 = 0 then coalesce(lowered, d.leaf) else d.leaf end as x
         from d left join path on d.doc_id is not distinct from path.doc_id and d.leaf = path.leaf left join crc on crc.id = d.doc_id
         union all
         select doc_id, lang, leaf, p, s, k + 1, sha256(p[k].a || x || p[k].b) from walk where k <= len(p))
select walk.doc_id, leaf, subroot, l[1] as root, sha256(s) as proof_sha256, x as folded_root, x = l[1] as verified
from walk join sub on walk.lang is not distinct from sub.lang, over where k = len(p) + 1 and len(over.l) = 1
"""

TRIE = rf"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i,
                  coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
ids as (select distinct c as id from t), {_CRC},
b as (select id as c, id - id % 20 as base, c % 4 as h, (select count(*) from t where t.c = id - id % 20 and i <= crc.c % 4) as lent
      from crc),
r as (select b.c, t.i, role, text from b join t on t.c = b.base and t.i <= b.h
      union all select b.c, t.i - b.h + b.lent, role, text from b join t on t.c = b.c and t.i > b.h),
p as (select c, i as d, len(regexp_extract_all(text, '[^ 	-
]+')) as w,
             sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') over (partition by c order by i)) as k
      from r union all select c, 0, 0, '' from b),
n as (select d, k, min(c) as c, count(*) as n, any_value(w) as w from p group by d, k),
ends as (select d, k, string_agg(c::varchar, ',' order by c) as l from (select c, max(d) as d, max_by(k, d) as k from p group by c) group by d, k),
kids as (select q.d, q.k, count(*) as n from n join p q on q.c = n.c and q.d = n.d - 1 group by q.d, q.k),
below as (select q.d, q.k, sum((n.n - 1) * n.w) as saved, count(*) filter (where kids.n is null) as leaves
          from n left join kids using (d, k) join p q on q.c = n.c and q.d <= n.d group by q.d, q.k)
select n.c as conv_id, n.d::bigint as depth, u.c as parent_conv_id, n.n as n_convs, coalesce(kids.n, 0) as n_children,
       leaves as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(l, '')) as ends_sha256
from n join below using (d, k) left join kids using (d, k) left join ends using (d, k)
left join p q on q.c = n.c and q.d = n.d - 1 left join n u on u.d = q.d and u.k = q.k
"""
