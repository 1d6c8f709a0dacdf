"""DuckDB SQL for the operators' queries that SQL can express."""

OP2 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 12) as h
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, [5, 2, 1][(((row_number() over (order by source nulls last)) - 1) % 3 + 1)::int] as wt, 3 * source_size as cap from src),
f as (select *, sum(source_size) over () as total, sum(wt) over () as wsum,
             coalesce(sum(cap) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
             coalesce(sum(wt) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0) as wdone
      from w),
lv as (select *, (total - capped)::double / (wsum - wdone)::double as lam from f),
top as (select max(lam) as lam from lv where lam * wt <= cap),
t as (select source, source_size, least(cap::double, top.lam * wt) as target from lv, top),
b as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as base from t),
lft as (select *, target - base * source_size as want from b),
g as (select source, h, sum(size)::bigint as n, count(*) as m from sized group by all),
r as (select *, row_number() over (partition by source, h) as rk from sized),
c as (select *, sum(n) over (partition by source order by h) as cum from g),
edge as (select l.source, min(c.h) as h from lft l join c on l.source is not distinct from c.source where c.cum > l.want group by l.source),
e as (select edge.source, edge.h, floor((l.want - (c.cum - c.n)) * c.m / c.n + 0.5) as take
      from edge join c on edge.source is not distinct from c.source and edge.h = c.h
      join lft l on l.source is not distinct from edge.source)
select s.doc_id, s.size, l.source_size, l.target,
       (s.size * least(l.base + case when s.h < e.h or (s.h = e.h and s.rk <= e.take) then 1 else 0 end, 3))::bigint as taken
from r s join lft l on s.source is not distinct from l.source
left join e on s.source is not distinct from e.source
"""

OP3 = """
with n as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
g as (select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from n)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""

OP5 = r"""
with low as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select distinct item_id, w, least(len(w), 10) as k from item where len(w) > 0),
win as (select item_id, k, list_slice(w, s, s + k - 1) as g from (select *, unnest(range(1, len(w) - k + 2)) as s from sized)),
lens as (select distinct k from win),
dw as (select doc_id, k, s, list_slice(w, s, s + k - 1) as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from low, lens where len(w) >= k)),
hit as (select d.doc_id, d.s, d.k, win.item_id from dw d join win on d.k = win.k and d.g = win.g),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from hit) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id, ',' order by item_id)) as items_sha256 from hit group by doc_id)
select l.doc_id, len(l.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
       coalesce(f.items_sha256, sha256('')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from low l left join covered c using (doc_id) left join found f using (doc_id)
"""

OP7 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, g from (
  select doc_id, array_to_string(list_slice(w, s, s + 3), ' ') as g from (select *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as s from w where len(w) > 0))),
n as (select doc_id, count(*) as n from sh group by doc_id),
sets as (select doc_id, md5(string_agg(g, chr(10) order by g)) as k from sh group by doc_id),
class as (select k, min(doc_id) as rep from sets group by k),
rs as (select sh.* from sh join class on sh.doc_id = class.rep),
inter as (select a.doc_id as u, b.doc_id as v, count(*) as i from rs a join rs b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select u, v from inter join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * i >= 80 * (nu.n + nv.n - i)),
way as (select u, v from link union select v, u from link),
reach as (select rep as u, rep as v from class union select r.u, b.v from reach r join way b on r.v = b.u),
comp as (select u, min(v) as c from reach group by u)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join sets using (doc_id) left join class using (k) left join comp on comp.u = class.rep
"""

OP6 = r"""
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw)::bigint as payload_bytes, sha1(raw) as hex from p),
n as (select *, min(page_id) over (partition by hex) as first from d)
select page_id, payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (5 * k // 4 + 1)::int, 2))::int >> (3 - (5 * k - 4 * (5 * k // 4)))::int) & 31) + 1)::int, 1)), lambda a, b: a || b) as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from n
"""

_PROB = "case when total{k} is null then {p} else (coalesce(n{k}, 0) + kinds{k} * {p}) / (total{k} + kinds{k}) end"


def _op8(order=3, alphabet=256):
    p = f"(1.0::double / {alphabet})"
    joins, columns = "", ""
    for k in range(order + 1):
        joins += f" left join seen s{k} on s{k}.k = {k} and s{k}.label = w.label and s{k}.g = right(w.gram, {k + 1}) left join ctx c{k} on c{k}.k = {k} and c{k}.label = w.label and c{k}.c = substr(w.gram, {order + 1 - k}, {k})"
        columns += f", s{k}.n as n{k}, c{k}.total as total{k}, c{k}.kinds as kinds{k}"
    for k in range(order + 1):
        p = "(" + _PROB.format(k=k, p=p) + ")"
    return rf"""
with h as (select page_id, coalesce(url, '') as url,
    translate(coalesce(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from h),
lab as (select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as label from r),
u as (select url, any_value(label) as label, count(*) as m from lab group by url),
spot as (select url, label, substr(repeat(chr(2), {order}) || url, i, {order + 1}) as gram from (select *, unnest(range(1, length(url) + 1)) as i from u)),
seen as (select label, k, right(gram, (k + 1)::int) as g, count(*) as n from spot, range({order + 1}) t(k) where label is not null group by all),
ctx as (select label, k, substr(g, 1, k::int) as c, sum(n) as total, count(*) as kinds from seen group by all),
want as (select gram, label from (select distinct gram from spot), (values ('allow'), ('block')) l(label)),
pr as (select w.gram, w.label{columns} from want w {joins}),
lp as (select gram, sum(case when label = 'allow' then 1 else -1 end * ln({p})) as delta from pr group by gram),
two as (select count(distinct label) = 2 as ok from u),
sc as (select u.url, label, m, coalesce(round(case when ok then s end / greatest(length(u.url), 1), 6), 0) as score
       from u left join (select url, sum(delta) as s from spot join lp using (gram) group by url) x using (url), two),
hist as (select greatest(least(floor(score * 1000), 20000), -20000) as bin, sum(case when label = 'allow' then m else 0 end) as a, sum(case when label = 'block' then m else 0 end) as b from sc where label is not null group by 1),
cum as (select bin, sum(a) over (order by bin desc) as ta, sum(b) over (order by bin desc) as tb, sum(a) over () as na, sum(b) over () as nb from hist),
cut as (select coalesce((select bin / 1000 from cum where na > 0 and nb > 0 order by ta::double / na - tb::double / nb desc, abs(bin), bin desc limit 1), 0) as t)
select page_id, host, path, rule, coalesce(lab.label, case when score >= t then 'allow' else 'block' end) as verdict
from lab join sc on sc.url = lab.url, cut
"""

#: unsigned crc32 of a list of bytes {bytes}, by the table t of `crc`
_CRC_TABLE = "crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t)"
_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_BYTES = "flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))"  # up to U+00FF

OP11 = rf"""
with recursive {_CRC_TABLE},
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as m
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 7 group by all),
h as (select w, m, {_CRC.format(bytes=_BYTES.format(text="coalesce(doc_id::varchar, '') || ':' || w"))} as h from runs, crc),
cut as (select m, case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word from h),
words as (select word, sum(m)::bigint as n from cut where length(word) >= 7 group by word having sum(m) >= 2),
del as (select word, n, i, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as d from (select *, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select del.word as a, w.word as b from del join words w on del.d = w.word),
pairs as (select a.word as a, b.word as b from del a join del b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select a, b from shorter union select b, a from shorter),
best as (select a, count(*) as n_near, arg_min(b, (-n, b)) as near, max(n) as near_n from pairs join words on words.word = b group by a),
f as (select word, n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n
  from words left join best on best.a = words.word),
way as (select word, form as root from f where form is not null union select way.word, f.form from way join f on f.word = way.root where f.form is not null),
ends as (select way.word, way.root from way join f on f.word = way.root where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from f left join ends on ends.word = f.word
"""

OP12 = r"""
with d as (select doc_id, coalesce(text, '') as t, md5(coalesce(text, '')) as h, row_number() over () as r from documents),
l as (select doc_id, h, r, line, pos, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, h, r, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as pos from d)),
gone as (select key from l where length(key) >= 1 group by key having count(distinct (doc_id, h)) >= 10),
s as (select l.r, count(*) as n_lines, count(gone.key) as n_dropped, string_agg(case when gone.key is null then line end, chr(10) order by pos) as kept
  from l left join gone on gone.key = l.key group by l.r)
select doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from s join d on d.r = s.r
"""

_PUT = "{{'c': {c} + {v}.c, 'a': '{a}' || {v}.a}}"


def _best(*options):
    return "list_sort([" + ", ".join(options) + "])[1]"


def _op13():
    shift = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    rerole = [2, 2, 3, 2]
    void = "{'c': 1000000000, 'a': ''}"
    read = []
    for q in range(4):
        options = [_PUT.format(c=2, v=f"v{q}", a="D")]
        options += [f"case when fault < 2 and initial = '{r}' then {_PUT.format(c='5 * fault', v=f'v{to}', a='K')} else {void} end" for r, to in shift[q].items()]
        options.append(f"case when fault < 2 then {_PUT.format(c='1 + 5 * fault', v=f'v{rerole[q]}', a='R')} else {void} end")
        read.append(f"{_best(*options)} as g{q}")
    put = lambda v: _PUT.format(c=5, v=v, a="I")
    crc = _CRC.format(bytes="list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: unicode(c)::bigint)")
    return rf"""
with recursive {_CRC_TABLE},
hashed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as f from conversations, crc),
rows_ as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case when f = 3 then 2 else 1 end)) as copy from hashed where f <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ink from rows_),
coded as (select *, substr(role, 1, 1) as initial, case when ink = '' then 2 when row_number() over (partition by conv_id, role, text order by i) > 1 then 3
  when ink[-1] in ('.', '!', '?') then 0 else 1 end as fault from placed),
ends as (select conv_id, count(*) as n from coded group by conv_id),
dp as (select conv_id, (n + 1)::bigint as i, {{'c': 0::bigint, 'a': ''}} as v0, {{'c': 10::bigint, 'a': 'II'}} as v1, {{'c': 5::bigint, 'a': 'I'}} as v2, {{'c': 0::bigint, 'a': ''}} as v3 from ends
  union all
  select conv_id, i, {_best("g0", put("h2"))} as v0, {_best("g1", put("h2"))} as v1, h2 as v2, h3 as v3 from (
    select *, {_best("g2", put("g3"))} as h2, {_best("g3", put("g2"))} as h3 from (
      select c.conv_id, c.i, {", ".join(read)} from dp join coded c on c.conv_id is not distinct from dp.conv_id and c.i = dp.i - 1))),
won as (select conv_id, v0.c as cost, v0.a as audit from dp where i = 1),
edits as (select conv_id, k, letter, sum((letter <> 'I')::int) over w as i, sum((letter <> 'D')::int) over w as stay, sum((letter <> 'D')::int) over (partition by conv_id) as stays
  from (select conv_id, unnest(string_split(audit, '')) as letter, unnest(range(length(audit))) as k from won where audit <> '') window w as (partition by conv_id order by k)),
made as (select e.conv_id, e.k, case when letter = 'K' then role when (stay + stays % 2) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end as line
  from edits e left join coded c on c.conv_id is not distinct from e.conv_id and c.i = e.i and letter <> 'I' where letter <> 'D'),
texts as (select conv_id, sha256(string_agg(line, chr(10) order by k)) as sha from made group by conv_id),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank, count(*) filter (fault = 3) as duplicate, count(*) filter (fault = 1) as truncated,
  count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(initial) over (partition by conv_id order by i) as before from coded) group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join won on won.conv_id is not distinct from o.conv_id left join facts on facts.conv_id is not distinct from o.conv_id
left join texts on texts.conv_id is not distinct from o.conv_id
"""


def oracle_sql():
    return {"op2_mix_sources": OP2, "op3_exact_dedup": OP3, "op5_decontaminate": OP5, "op6_warc": OP6, "op7_near_duplicates": OP7, "op8_url_filter": _op8(), "op11_spelling_variants": OP11, "op12_line_dedup": OP12, "op13_conversation_repair": _op13()}
