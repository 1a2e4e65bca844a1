"""DuckDB SQL of the training-data queries."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def spaced(text: str) -> str:
    """Words between blanks and the controls 9 to 13."""
    return rf"regexp_extract_all({lowered(text)}, '[^\x20\x09-\x0D]+')"


NGRAM_JOIN = f"""
with recursive w as (select doc_id, coalesce({spaced("text")}, []) as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as g from w),
sized as (select doc_id, len(g) as n from sets),
flat as (select doc_id, unnest(g) as s from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as o from flat a join flat b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from pairs join sized p on p.doc_id = x join sized q on q.doc_id = y where 100 * o >= 75 * (p.n + q.n - o)),
reach(x, y) as (select doc_id, doc_id from sized union select r.x, l.y from reach r join links l on r.y = l.x)
select doc_id, n::bigint as n_shingles, (select min(y) from reach where x = doc_id) as component_id from sized
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
with d as (select doc_id, coalesce(regexp_extract_all({lowered("text")}, '{_ALNUM}'), []) as w from documents),
b as (select item_id::varchar as item, coalesce(regexp_extract_all({lowered("text")}, '{_ALNUM}'), []) as w from benchmark),
bw as (
  select distinct item, array_to_string(w[i:i + 12], ' ') as g, least(len(w), 13) as n
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.g = bw.g and dw.n = bw.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

LINE_DEDUP = """
with l as (select doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) as i, string_split(text, chr(10)) as a from documents),
f as (select doc_id, source, i, a[i] as line, trim(a[i]) as bare from l),
c as (select source, bare, count(*) as n from (select distinct doc_id, source, bare from f where bare <> '') group by all),
t as (select source, count(*) as pages from documents group by 1),
bad as (select c.source, c.bare from c join t on c.source is not distinct from t.source where n >= 3 and n * 1000 > pages * 50),
k as (
  select f.doc_id, count(*) as n_lines, count(bad.bare) as n_dropped, string_agg(f.line, chr(10) order by f.i) filter (where bad.bare is null) as kept
  from f left join bad on f.source is not distinct from bad.source and f.bare = bad.bare group by 1)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, md5(coalesce(kept, '')) as kept_md5
from documents d left join k using (doc_id)
"""

_ENTROPY = "(ln(list_sum(list_transform(ps, lambda p: pow(p, m)))) - m * list_sum(list_transform(ps, lambda p: pow(p, m) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, m))))"
_REPEATS = "(list_max(list_transform(ps, lambda p: pow(p, m) / p)) / list_sum(list_transform(ps, lambda p: pow(p, m))))"


def mixing_of(documents: str) -> str:
    """The mix over a table or subquery (doc_id, source, text); the budget is its number of tokens."""
    return rf"""
with recursive n as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as tokens from {documents}),
s as (
  select source, total, least(ceil(total / 100000)::bigint, 65536) as blocks
  from (select source, sum(tokens)::bigint as total from n group by 1) where total > 0),
a as (select sum(total)::bigint as budget, count(*) as k from s),
ps as (select list(total / budget) as ps, any_value(k) as k from s, a),
flat(step, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when h >= 0.97 * ln(k) then m else lo end, case when h >= 0.97 * ln(k) then hi else m end
  from (select step, lo, hi, m, k, {_ENTROPY} as h from (select step, lo, hi, (lo + hi) / 2 as m, ps, k from flat, ps where step < 32))),
steep(step, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when r > 4.0 then m else lo end, case when r > 4.0 then hi else m end
  from (select step, lo, hi, m, {_REPEATS} as r from (select step, lo, hi, (lo + hi) / 2 as m, ps from steep, ps where step < 32))),
x as (select greatest(f.lo, case when t.lo > 0 then t.hi else 0.0 end) as x from flat f, steep t where f.step = 32 and t.step = 32),
z as (select sum(pow(total / budget, x)) as z from s, a, x),
plan as (
  select source, total, blocks, own, (own // total) as full, own - (own // total) * total as rest
  from (select source, total, blocks, floor(round(pow(total / budget, x) / z * budget, 3))::bigint as own from s, a, x, z)),
b as (
  select doc_id, n.source, tokens, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint % blocks as block
  from n join plan on n.source is not distinct from plan.source),
sized as (select source, block, sum(tokens)::bigint as size from b group by all),
e as (
  select z.source, z.block, size, "full", rest, unnest(range(0, "full" + 1)) as epoch
  from sized z join plan p on z.source is not distinct from p.source),
o as (
  select *, row_number() over w as place, sum(size) over (w rows between unbounded preceding and current row) as upto from e
  window w as (partition by source, epoch order by md5('17:' || coalesce(source, '') || ':' || epoch || ':' || block), block)),
r as (
  select * from (select *, case when epoch < "full" then size else rest - upto + size end as room from o) where room > 0 or epoch < "full"),
j as (select doc_id, b.source, tokens, epoch, place, size, room, "full", b.block from b join r on b.source is not distinct from r.source and b.block = r.block),
c as (
  select *, sum(tokens) over (
    partition by source, block order by md5('17:' || coalesce(source, '') || ':' || epoch || ':' || coalesce(doc_id::varchar, '')), doc_id, tokens
    rows between unbounded preceding and current row) as got
  from j where epoch = "full" and size > room)
select doc_id, source, tokens, epoch::bigint as epoch, place::int as place from j where epoch < "full" or size <= room
union all select doc_id, source, tokens, epoch::bigint, place::int from c where got <= room
"""


MIXING = mixing_of("documents")

#: Entries of CRC-32 (the reflected polynomial 0xEDB88320), as the column `entry` of the table `crc`.
_CRC_TABLE = """crc as (
  select list(list_reduce(range(8), lambda c, _k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) order by i) as entry from range(256) t(i))"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; needs the table `crc`."""
    octets = f"list_transform(range(0, len(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


PREFIX_TRIE = f"""
with {_CRC_TABLE},
t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as place,
    len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as mark, coalesce(len({spaced("text")}), 0) as words
  from conversations where conv_id is not null),
ids as (select conv_id, conv_id - conv_id % 20 as base, ({crc32("conv_id::varchar")} % 4) as h from (select distinct conv_id from t), crc),
r as (
  select conv_id, place, mark, words from t join ids using (conv_id) where place > h
  union all select ids.conv_id, place, mark, words from t join ids on t.conv_id = ids.base where place <= h),
ranked as (select conv_id, row_number() over (partition by conv_id order by place) as depth, mark, words from r),
chain as (
  select conv_id, depth, words, list(sha256(mark)) over (partition by conv_id order by depth) as marks from ranked),
p as (
  select conv_id, depth, words, array_to_string(marks, ',') as node, array_to_string(marks[:-2], ',') as parent from chain
  union all select conv_id, 0, 0, '', null from ids),
lengths as (select conv_id, max(depth) as len from p group by 1),
n as (
  select node, any_value(parent) as parent, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = len), '')) as ends_sha256
  from p join lengths using (conv_id) group by 1),
kids as (select parent as node, count(*) as k from n where parent is not null group by 1),
own as (select n.*, coalesce(k, 0) as n_children from n left join kids using (node)),
sums as (
  select a.node, sum((b.n_children = 0)::bigint) as n_leaves, sum((b.n_convs - 1) * b.words) as saved_tokens
  from own b join p a on a.conv_id = b.conv_id and a.depth <= b.depth group by 1)
select own.conv_id, own.depth::bigint as depth, up.conv_id as parent_conv_id, own.n_convs::bigint as n_convs, own.n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, own.ends_sha256
from own join sums using (node) left join n up on own.parent = up.node
"""

#: The rules of the URL filter, and site names that are not wanted.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UNWANTED = r"(?:^|\.)((?:ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\..+)$"

_RULE_ROWS = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)
URL_FILTER = rf"""
with rules(verdict, host, path) as (values {_RULE_ROWS}),
u as (
  select page_id, {lowered("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
hosts as (
  select host, exists (select 1 from (select distinct regexp_extract(host, '{UNWANTED}', 1) as site from u where regexp_extract(host, '{UNWANTED}', 1) <> '') s where h.host = site or ends_with(h.host, '.' || site)) as listed
  from (select distinct host from u) h),
fit as (
  select distinct u.host, u.path, arg_max(r.host || r.path, len(r.host || r.path) * 1000 + len(r.host)) as rule, arg_max(r.verdict, len(r.host || r.path) * 1000 + len(r.host)) as verdict
  from (select distinct host, path from u) u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by all)
select page_id, u.host, u.path, rule, coalesce(fit.verdict, case when listed then 'block' else 'allow' end) as verdict
from u join hosts using (host) left join fit on u.host = fit.host and u.path = fit.path
"""

SPELLING = rf"""
with recursive {_CRC_TABLE},
runs as (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all({lowered("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents) group by all),
marked as (select run, n, {crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs, crc),
words as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, sum(n)::bigint as n
  from marked group by 1 having length(word) >= 5 and sum(n) >= 3),
cut as (select word, n, i, substr(word, 1, i) as a, substr(word, i + 2) as b from words, unnest(range(0, length(word))) t(i)),
near as (
  select x.word, y.word as other, y.n from cut x join cut y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select cut.word, w.word, w.n from cut join words w on cut.a || cut.b = w.word
  union select w.word, cut.word, cut.n from cut join words w on cut.a || cut.b = w.word),
ranked as (select word, other, n as form_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by n desc, other) as k from near),
found as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * w.n then other end as form, case when form_n >= 2 * w.n then form_n end as form_n
  from words w left join ranked r on w.word = r.word and k = 1),
walk(word, reached, steps) as (
  select word, word, 0 from found
  union all select walk.word, found.form, steps + 1 from walk join found on walk.reached = found.word where found.form is not null),
ends as (select word, arg_max(reached, steps) as root from walk group by 1)
select word, form, root, n, n_near, form_n from found join ends using (word)
"""
