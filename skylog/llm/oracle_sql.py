"""The text operators whose results SQL can say, over the same tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

#: The table of crc32 as a CTE, and with it the unsigned crc32 of a string's UTF-8 bytes.
_CRC_TABLE = """crc_table as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384)
  else c >> 1 end) order by i) as crc_of from (select unnest(range(256)) as i))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({0}))), lambda i: cast('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2]
  as bigint))), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"""

OP1 = f"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words
  where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(least_reached, doc_id)) as component_id
from words left join sizes using (doc_id) left join (select a as doc_id, min(b) as least_reached from reach group by a) using (doc_id)
"""

_BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
with words as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORDS}') as w from documents),
items as (select cast(item_id as varchar) as item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORDS}') as w from benchmark),
sought as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s from (select item_id, w, least(10, len(w)) as k,
  unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
there as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words,
  (select distinct k from sought) where len(w) >= k)),
hits as (select doc_id, i, k, item_id from there join sought using (k, s)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated from words left join covered using (doc_id) left join named using (doc_id)
"""

OP10 = f"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)),
repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from repeated),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (
  select e.doc_id, string_agg(word, ' ' order by e.p) as rest, count(*) as n from each e left join gone g on g.doc_id = e.doc_id and g.p = e.p
  where g.p is null group by e.doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from words left join kept using (doc_id)
"""

OP11 = rf"""
with recursive {_CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
folded as (select doc_id, {_LOWER.format("run")} as run, count(*) as n from runs group by all),
hashed as (select run, n, {_CRC.format("(coalesce(cast(doc_id as varchar), '') || ':' || run)")} as h from folded, crc_table where length(run) >= 5),
slipped as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
places as (select word, n, unnest(range(length(word))) as i from words),
cuts as (select distinct word, n, left(word, i) || substr(word, i + 2) as cut from places),
puts as (select word, n, left(word, i) || '?' || substr(word, i + 2) as put from places),
shorter as (select c.word, c.n, w.word as near, w.n as near_n from cuts c join words w on w.word = c.cut),
near as (
  select * from shorter union all select near, near_n, word, n from shorter
  union all select a.word, a.n, b.word, b.n from puts a join puts b on a.put = b.put and a.word <> b.word),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by word),
forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n
  from words left join best using (word)),
ways(word, seen, steps) as (
  select word, word, 0 from forms union all select y.word, f.form, y.steps + 1 from ways y join forms f on f.word = y.seen where f.form is not null)
select word, form, root, n, n_near, form_n from forms join (select word, arg_max(seen, steps) as root from ways group by word) using (word)
"""

OP12 = f"""
with {_CRC_TABLE},
own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as place, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
lengths as (select conv_id, count(*) as n from own group by conv_id),
convs as (
  select l.conv_id as c, l.conv_id - l.conv_id % 100 as base, {_CRC.format("cast(l.conv_id as varchar)")} % 6 as h from lengths l, crc_table),
openings as (select c, base, h, least(h, coalesce(n, 0)) as shared from convs left join lengths on conv_id = base),
rebuilt as (
  select c, place + 1 as d, role, text from openings join own on conv_id = base and place < h
  union all select c, place - h + shared + 1, role, text from openings join own on conv_id = c and place >= h),
paths as (
  select c, d, md5(string_agg(md5(length(role) || ':' || role || text), '') over (partition by c order by d)) as k, length(text) as n from rebuilt
  union all select c, 0, '', 0 from convs),
nodes as (select d, k, min(c) as m, count(*) as n_convs, any_value(n) as n from paths group by d, k),
passed as (select c, d, m, n_convs, nodes.n, max(d) over (partition by c) as last from paths join nodes using (d, k)),
owned as (
  select a.m, a.d, b.m as up, a.n_convs, (a.n_convs - 1) * a.n as saved from passed a left join passed b on b.c = a.c and b.d = a.d - 1
  where a.c = a.m),
children as (select up as m, d - 1 as d, count(*) as n_children from owned where d > 0 group by all),
judged as (select *, coalesce(n_children, 0) as kids from owned left join children using (m, d)),
sums as (
  select p.m, p.d, count(*) filter (j.kids = 0) as n_leaves, cast(sum(j.saved) as bigint) as saved_tokens from judged j join passed p
  on p.c = j.m and p.d <= j.d group by all),
ends as (select m, d, string_agg(cast(c as varchar), ',' order by c) as ids from passed where d = last group by all)
select j.m as conv_id, j.d as depth, j.up as parent_conv_id, j.n_convs, j.kids as n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(ids, '')) as ends_sha256 from judged j join sums s on s.m = j.m and s.d = j.d left join ends e on e.m = j.m and e.d = j.d
"""
