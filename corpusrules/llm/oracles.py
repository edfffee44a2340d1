"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""
with recursive w as (select doc_id, {_SPLIT.format(_LOWER)} as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as sh
  from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (
  select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l as (select x, y from p union select y, x from p),
r as (select doc_id as x, doc_id as y from documents union select r.x, l.y from r join l on r.y = l.x)
select s.doc_id, len(s.sh)::bigint as n_shingles, min(r.y) as component_id
from s join r on r.x = s.doc_id group by s.doc_id, s.sh
"""

OP4 = f"""
with w as (select doc_id, {_SPLIT.format("text")} as ws from documents),
k as (select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50),
h as (select doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as g from k),
f as (select g, min(doc_id) as lo from h group by g having min(doc_id) <> max(doc_id)),
c as (select distinct doc_id, unnest(range(i, i + 50)) as j from h join f using (g) where doc_id > lo),
m as (select doc_id, list(j) as js, count(*) as n from c group by doc_id),
u as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
t as (
  select u.doc_id, string_agg(word, ' ' order by u.j) as kept from u left join c on u.doc_id = c.doc_id and u.j = c.j
  where c.j is null group by u.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(m.n, 0)::bigint as n_removed,
  sha256(coalesce(t.kept, '')) as kept_sha256
from w left join m using (doc_id) left join t using (doc_id)
"""

_MEASURED = f"""
w as (select doc_id, coalesce(text, '') as text, {_SPLIT.format("text")} as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from documents),
k as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
h as (select doc_id, i, ws[i : i + 2] as g from k),
d as (select doc_id, i, count(*) over (partition by doc_id, g) as c from h),
v as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from d where c > 1) group by doc_id),
q as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(v.n, 0)::bigint as n_repeat_words,
  length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::bigint as n_upper,
  length(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_exclaims
  from w left join v using (doc_id))
"""

OP7 = f"""
with {_MEASURED},
b as (select *,
  (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
  + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end
  + case when word_chars < 2 * n_words or word_chars > 15 * n_words then 16 else 0 end
  + case when 100 * n_upper > 40 * word_chars then 32 else 0 end + case when n_exclaims > n_words then 64 else 0 end)::bigint as failed
  from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
  failed & 3 <> 0 as base_failed, failed = 0 as kept from b
"""

_TOKENS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = f"""
with w as (select doc_id, {_TOKENS.format(_LOWER)} as ws from documents),
b as (select item_id::varchar as item_id, {_TOKENS.format(_LOWER)} as ws from benchmark where item_id is not null),
p as (
  select item_id, case when len(ws) < 10 then ws else ws[i : i + 9] end as g
  from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) as i from b where len(ws) > 0)),
z as (select distinct len(g) as n from p),
k as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) as i, ws from w, z where len(ws) >= n),
h as (select doc_id, i, n, item_id from k join p on k.ws[k.i : k.i + k.n - 1] = p.g),
c as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
t as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as ids from h group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
  sha256(coalesce(t.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from w left join c using (doc_id) left join t using (doc_id)
"""

OP13 = r"""
with d as (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
w2 as (select * from w where len(ws) > 0),
nn as (select lang, sum(len(ws))::bigint as n from w2 group by lang),
o as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w2),
g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase
  from o, (select unnest(range(1, 6)) as k) q where i + k - 1 <= len(ws)),
f as (select lang, k, phrase, count(*)::bigint as f from g group by lang, k, phrase),
c as (select lang, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= 100),
cut as (select lang, phrase, a, ws, unnest(range(1, len(ws))) as j from c),
s as (
  select cut.lang, cut.phrase, cut.a, cut.j, fl.f as l, fr.f as r, nn.n,
    ((1000::hugeint * cut.a * nn.n) // (fl.f::hugeint * fr.f))::bigint as score
  from cut
  join f fl on fl.lang = cut.lang and fl.phrase = array_to_string(cut.ws[1 : cut.j], ' ')
  join f fr on fr.lang = cut.lang and fr.phrase = array_to_string(cut.ws[cut.j + 1 : len(cut.ws)], ' ')
  join nn on nn.lang = cut.lang),
b as (select lang, phrase, a, l, r, n, score from s
  qualify row_number() over (partition by lang, phrase order by score, j) = 1),
sub as (
  select lang, a as longer, array_to_string(ws[i : i + k - 1], ' ') as phrase
  from (select lang, a, ws, unnest(range(2, len(ws))) as k from c where len(ws) >= 3) x,
    lateral (select unnest(range(1, len(x.ws) - x.k + 2)) as i) y),
cov as (select lang, phrase, max(longer) as longer from sub group by lang, phrase),
kept as (select b.* from b left join cov using (lang, phrase) where cov.longer is null or cov.longer < b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase asc) as rank from kept)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op4_substring_dedup": OP4,
    "op7_quality_rules": OP7,
    "op10_benchmark_decontamination": OP10,
    "op13_phrase_collocations": OP13,
}
