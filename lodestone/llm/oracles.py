"""SQL for the queries that SQL can express, over the same tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_BENCH_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _host(url: str) -> str:
    return _LOWER.format(f"coalesce(regexp_extract({url}, '://([^/?#]*)', 1), '')")


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


_RULE = f"case when {_fits('example.net', '/en/')} then 'example.net/en/' when {_fits('example.com', '/de/')} then 'example.com/de/' when {_fits('org', '/fr/')} then 'org/fr/' when {_fits('net', '/')} then 'net/' end"
_LINKS = r'''list_concat(regexp_extract_all(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1), list_concat(regexp_extract_all(html, '(?i)<link\s[^>]*href\s*=\s*["'']?([^"''\s>]+)[^>]*rel\s*=\s*["'']?canonical', 1),
  list_concat(regexp_extract_all(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*?content\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1), regexp_extract_all(html, '(?i)<meta\s[^>]*content\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)[^>]*http-equiv\s*=\s*["'']?refresh', 1))))'''
_NAMED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_PLAIN_PATH = "case when starts_with({0}, '/') and contains({0}, '/.') then list_reduce([''] || string_split({0}, '/')[2:], lambda a, x: case when x = '.' then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end) || case when string_split({0}, '/')[-1] in ('.', '..') then '/' else '' end else {0} end"


def _query(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://[^/?#]*[^?#]*([^#]*)', 1), '')"


#: Aliases here: canonical links and refreshes, resolved and followed to all that is reachable (numbered character references aside).
OP1 = f'''
with recursive q as (select url, regexp_extract(url, '^(.*?)://', 1) as scheme, {_host('url')} as base_host, {_path('url')} as base_path, {_NAMED.format('link')} as link from (select url, unnest({_LINKS}) as link from pages where contains(url, '://'))),
t as (select url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then scheme || ':' || link when starts_with(link, '/') then scheme || '://' || base_host || link when starts_with(link, '?') then scheme || '://' || base_host || base_path || link
  when starts_with(link, '#') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null else scheme || '://' || base_host || coalesce(nullif(regexp_replace(base_path, '[^/]*$', ''), ''), '/') || link end as link from q where link <> ''),
u as (select url, link, {_path('link')} as p from t where link is not null),
l as (select url, regexp_extract(link, '^(.*?://[^/?#]*)', 1) || {_PLAIN_PATH.format('p')} || {_query('link')} as link from u),
n as (select url from pages where contains(url, '://') union select link from l),
h as (select url, {_host('url')} as host, {_path('url')} as path from n),
d as (select *, host || coalesce(nullif({_PLAIN_PATH.format('path')}, ''), '/') || {_query('url')} as node, {_RULE} as rule from h),
e as (select a.node as x, b.node as y from l join d a on a.url = l.url join d b on b.url = l.link),
s as (select x, y from e union select y, x from e),
c as (select x as node, x as other from s union select c.node, s.y from c join s on s.x = c.other),
v as (select c.node, min(case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end) as decision from c join d on d.node = c.other group by c.node)
select p.page_id, coalesce(d.host, '') as host, coalesce(d.path, '') as path, d.rule,
  case when d.rule in ('net/', 'example.com/de/') then 'block' when d.rule is not null then 'allow' else coalesce(v.decision, 'allow') end as verdict
from pages p left join d on d.url = p.url left join v on v.node = d.node
'''

OP2 = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
n as (select doc_id, len(s) as n from s),
x as (select doc_id, len(s) as n, hash(unnest(s)) as x from s),
p as (select a.doc_id as a, b.doc_id as b, a.n + b.n as n, count(*) as i from x a join x b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
h as (select a, b from p where 100 * i >= 85 * (n - i)),
l as (select a, b from h union all select b, a from h),
k as (select a as doc_id, count(*) as n_links from l group by 1),
c as (select doc_id, doc_id as other from n union select c.doc_id, l.b from c join l on l.a = c.other)
select n.doc_id, n.n as n_shingles, min(c.other) as component_id, coalesce(max(k.n_links), 0) as n_links from n join c using (doc_id) left join k using (doc_id) group by all
"""

OP6 = f"""
with i as (select item_id::varchar as item, {_BENCH_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark),
g as (select distinct item, least(len(w), 13) as n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') as window_ from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) as k from i where len(w) > 0)),
d as (select doc_id, {_BENCH_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
l as (select distinct n from g),
p as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as window_ from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, l where len(w) >= n)),
f as (select doc_id, item, k, p.n as n from p join g using (window_)),
h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from f) group by 1),
t as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from f) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

OP9 = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
p as (select doc_id, k, array_to_string(w[k:k + 34], ' ') as v from (select doc_id, w, unnest(range(1, len(w) - 33)) as k from d where len(w) >= 35)),
r as (select doc_id, k from (select doc_id, k, count(*) over (partition by v) as n from p) where n > 1),
g as (select doc_id, list(distinct pos) as gone from (select doc_id, unnest(range(k, k + 35)) as pos from r) group by 1),
x as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as pos from d),
m as (select distinct doc_id, unnest(gone) as pos from g),
y as (select x.doc_id, string_agg(x.x, ' ' order by x.pos) as kept, count(*) as n from x left join m on m.doc_id = x.doc_id and m.pos = x.pos where m.pos is null group by 1)
select d.doc_id, len(w) as n_words, len(w) - coalesce(y.n, 0) as n_removed, sha256(coalesce(y.kept, '')) as kept_sha256 from d left join y using (doc_id)
"""

#: CRC-32 of a text's bytes: a table made by its rule, one step a byte.
_CRC_TABLE = "crc as (select list_transform(range(0, 256), lambda x: list_reduce([x] || range(0, 8), lambda c, k: xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end))) as steps)"
_CRC = "xor(4294967295, list_reduce([4294967295::bigint] || list_transform(range(0, octet_length(encode({0}))), lambda k: ('0x' || hex(encode({0}))[2 * k + 1:2 * k + 2])::bigint), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


def _framed(*columns: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')" for c in columns) + "))"


_ALTERED = _LOWER.format("text")

#: A tree of digests level by level: ``{0}`` has the leaves as (g, i, digest).
_TREE = "select g, 0 as level, i, digest from {0} union all select g, level + 1, i // 16, sha256(string_agg(digest, '' order by i)) from (select *, count(*) over (partition by g) as n from {1}) where n > 1 group by g, level, i // 16"

OP13 = f"""
with recursive {_CRC_TABLE},
l as (select row_number() over () as id, doc_id, source, {_framed('doc_id', 'source', 'lang', 'n_chars', 'text')} as leaf, case when {_CRC.format('doc_id::varchar')} % 5 = 0 then {_framed('doc_id', 'source', 'lang', 'n_chars', _ALTERED)} end as altered from documents, crc),
o as (select *, coalesce('=' || source, '') as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, leaf as digest from l),
t as ({_TREE.format('o', 't')}),
r as (select g, digest as subroot, level as depth from (select *, row_number() over (partition by g order by level desc) as k from t) where k = 1),
q as (select g as name, subroot, depth, '' as g, row_number() over (order by encode(g)) - 1 as i, subroot as digest from r),
u as ({_TREE.format('q', 'u')}),
n as (select t.g, level, i, digest from t join r on r.g = t.g and level < depth union all select r.g, depth + level, u.i, digest from u, r where u.level < (select max(level) from u)),
e as (select max(level) as height, arg_max(digest, level) as root from u),
w as (select o.id, o.g, o.i, q.i as top, q.depth, q.depth + height as steps, q.subroot, e.root, doc_id, leaf, coalesce(altered, leaf) as start from o join q on q.name = o.g, e),
v as (select id, g, level, case when level < depth then i // (16 ** level)::bigint else top // (16 ** (level - depth))::bigint end as own, steps from (select *, unnest(range(0, steps)) as level from w)),
b as (select v.id, v.level, string_agg(case when n.i <> own then digest end, '' order by n.i) as siblings, coalesce(string_agg(case when n.i < own then digest end, '' order by n.i), '') as before, coalesce(string_agg(case when n.i > own then digest end, '' order by n.i), '') as after from v join n on n.g = v.g and n.level = v.level and n.i // 16 = own // 16 group by all),
f as (select id, 0 as level, start as held from w union all select f.id, f.level + 1, sha256(before || held || after) from f join b on b.id = f.id and b.level = f.level),
p as (select id, sha256(coalesce(string_agg(siblings, '' order by level), '')) as proof from b group by id)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, held as folded_root, held = root as verified
from w join f on f.id = w.id and f.level = w.steps left join p on p.id = w.id
"""

OP11 = f"""
with {_CRC_TABLE},
d as (select row_number() over () as id, doc_id, {_BENCH_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
x as (select id, unnest(w) as x from d),
y as (select unnest({_BENCH_WORDS.format(_LOWER.format("coalesce(text, '')"))}) as x from benchmark),
v as (select x, {_CRC.format('x')} % 10000 as bucket from (select x from x union select x from y) z, crc),
s as (select bucket, count(*)::double as n from x join v using (x) group by 1),
t as (select bucket, count(*)::double as n from y join v using (x) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + 10000) / ((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0) from t) + 10000)))) as gain from s full join t using (bucket)),
p as (select id, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from x join v using (x) join g using (bucket) group by 1),
h as (select d.id, doc_id, coalesce(n, 0) as n, coalesce(weight, 0) as weight, ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint::double as h from d left join p on p.id = d.id),
c as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
k as (select *, case when n >= 20 then row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) end as place, (select count(*) from c where n >= 20) as fit from c)
select doc_id, n as n_features, weight, score, case when place <= 10 * fit // 100 then place end as rank from k
"""
