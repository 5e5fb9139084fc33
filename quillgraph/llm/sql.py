"""DuckDB SQL for the queries that SQL can express. Each is written from the contract, not from the operator."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}


def contamination(docs: str = "documents") -> str:
    return rf"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') as w from {docs}),
i as (select item_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') as w from benchmark),
iw as (select distinct item_id, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as g, least(10, len(w)) as m
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
dw as (select rid, p, m, array_to_string(w[p : p + m - 1], ' ') as g
  from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as p from d, (select distinct m from iw) where len(w) >= m)),
hit as (select rid, p, dw.m, item_id from dw join iw on dw.g = iw.g and dw.m = iw.m),
covered as (select rid, count(distinct q) as n from (select rid, unnest(range(p, p + m)) as q from hit) group by rid),
items as (select rid, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join covered c using (rid) left join items using (rid)"""


ORACLES["op10_benchmark_winnowing"] = contamination()


def secrets(docs: str = "documents", reach: int = 200) -> str:
    kinds = [
        (0, "assign", "secret", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        (1, "access", "identifier", r"AKIA[A-Z0-9]+", 20),
        (2, "hex", "secret", r"[0-9a-f]+", 24),
        (3, "account", "identifier", r"""(client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+""", 0),
        (4, "blob", "secret", r"[A-Za-z0-9+/]{32,}", 0),
        (5, "endpoint", "endpoint", r"""(https?|ftp|jdbc:[a-z]+|postgres|mysql|amqp)://[A-Za-z0-9._~:@%-]+""", 0),
    ]
    found = []
    for n, kind, role, pattern, least in kinds:
        for prefix in (r"(password", r"(client", r"(https"):
            if pattern.startswith(prefix):
                pattern = f"((?i:{pattern[1:].replace(')', '))', 1)}"
        pattern = pattern.replace("'", "''")
        group = 2 if kind == "assign" else 0
        found.append(f"""select rid, {n} as o, '{kind}' as kind, '{role}' as role, {least} as least,
          unnest(list_zip(regexp_extract_all(t, '{pattern}'), regexp_extract_all(t, '{pattern}', {group}), string_split_regex(t, '{pattern}'))) as z, generate_subscripts(string_split_regex(t, '{pattern}'), 1) as i from d""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from {docs}),
raw as ({' union all '.join(found)}),
placed as (select rid, o, kind, role, least, z[1] as m, z[2] as g, sum(length(z[3]) + coalesce(length(z[1]), 0)) over (partition by rid, o order by i) as e from raw),
part as (select rid, o, kind, role, (e - length(m))::bigint as s, e::bigint as e from placed where m is not null and m <> '' and length(g) >= least),
ok as (select p.* from part p where o < 3
    or role = 'identifier' and exists (select 1 from part q where q.rid = p.rid and q.role = 'secret' and abs(q.s - p.s) <= {reach} and (q.s >= p.e or p.s >= q.e))
    or role = 'secret' and exists (select 1 from part q where q.rid = p.rid and q.role = 'identifier' and abs(q.s - p.s) <= {reach} and (q.s >= p.e or p.s >= q.e))
    or role = 'endpoint' and exists (select 1 from part q where q.rid = p.rid and q.role = 'secret' and abs(q.s - p.s) <= {reach} and (q.s >= p.e or p.s >= q.e))
      and exists (select 1 from part q where q.rid = p.rid and q.role = 'identifier' and abs(q.s - p.s) <= {reach} and (q.s >= p.e or p.s >= q.e))),
per as (select rid, count(*) filter (o = 0) as a, count(*) filter (o = 1) as k, count(*) filter (o = 2) as h,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, o) filter (o < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, o) as spans from ok group by rid)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(k, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (rid)"""


ORACLES["op1_secret_linking"] = secrets()


def quality(docs: str = "documents") -> str:
    from quillgraph.llm.quality import COMMON_WORDS

    common = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON_WORDS)) + "]"
    classes = ["[^aeiou]", "[^b-df-hj-np-tv-z]", "[^A-Z]", "[^0-9]", r"[^\x09-\x0D\x20]", r"[^\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x{80}-\x{23F}]", r"[^\x{240}-\x{10FFFF}]"]
    counted = ", ".join(f"length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)
    jsd = """sqrt(greatest(0, least(1, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)))"""
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as t, row_number() over () as rid from {docs}),
w as (select rid, doc_id, lang, t, regexp_extract_all(t, '{SPACED}') as w, regexp_extract_all({LOWER.format('t')}, '{SPACED}') as lw from d),
lines as (select rid, unnest(string_split(t, chr(10))) as line from d),
dup as (select rid, (count(*) - count(distinct line)) as n from lines where regexp_matches(line, '{SPACED}') group by rid),
win as (select rid, p, array_to_string(w[p : p + 4], ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as p from w where len(w) >= 5)),
twice as (select rid, p from (select rid, p, count(*) over (partition by rid, g) as n from win) where n > 1),
rep as (select rid, count(distinct q) as n from (select rid, unnest(range(p, p + 5)) as q from twice) group by rid),
bins as (select rid, lang, len(w) as n_words, unnest(range(0, 8)) as b, unnest([{counted}]) as n, 0 as part from w
  union all select rid, lang, n_words, b, n, 1 from (select rid, lang, len(w) as n_words, unnest(range(0, len({common}))) as b,
    unnest(list_transform({common}, lambda x: len(list_filter(lw, lambda y: y = x)))) as n from w)
  union all select rid, lang, len(w), 1000, len(list_filter(lw, lambda y: not list_contains({common}, y))), 1 from w),
ref as (select lang, part, b, n / sum(n) over (partition by lang, part) as q from (select lang, part, b, sum(n) as n from bins where n_words >= 50 and lang is not null group by all)),
own as (select rid, n_words, part, b, n / nullif(sum(n) over (partition by rid, part), 0) as p from bins where n_words >= 80),
far as (select rid, r.lang, o.part, {jsd} as far from own o join ref r on o.part = r.part and o.b = r.b group by all),
pair as (select rid, lang, max(far) filter (part = 0) as c, max(far) filter (part = 1) as v from far group by all),
best as (select rid, c, v, greatest(c / 0.27, v / 0.335) as worst from pair qualify row_number() over (partition by rid order by greatest(c / 0.27, v / 0.335), lang) = 1),
base as (select rid, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join dup using (rid) left join rep using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and coalesce(worst <= 1, true) as kept, round(c, 6) as class_distance, round(v, 6) as word_distance
from base left join best using (rid)"""


ORACLES["op2_distribution_divergence"] = quality()


def licenses(docs: str = "documents", least: float = 0.8) -> str:
    from quillgraph.llm.licenses import TEMPLATES

    rows = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    norm = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))".format(LOWER)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
with t as (select name, {grams} as g from (select name, string_split({norm.format('body')}, ' ') as w from (values {rows}) v(name, body))),
d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from {docs}),
cut as (select distinct rid, {norm.format('seg')} as seg from (select rid, unnest(list_concat(string_split_regex(text, '[.!?][ \t\r]+|\n+'), string_split_regex(text, '\n[ \t\r]*\n'), [text])) as seg from d)),
s as (select rid, seg, {grams} as g from (select rid, seg, string_split(seg, ' ') as w from cut)),
m as (select rid, seg, name, 2.0::double * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) as dice from s join t on len(s.g) between len(t.g) * {least / (2 - least)} - 0.01 and len(t.g) / {least / (2 - least)} + 0.01 where len(s.g) > 0),
best as (select * from m where dice >= {least} - 1e-9 qualify row_number() over (partition by rid, seg order by dice desc, name) = 1),
per as (select rid, count(*) as n, string_agg(distinct name, ',' order by name) as names, max(dice) as top from best group by rid)
select doc_id, coalesce(n, 0)::bigint as n_segments, coalesce(names, '') as licenses, round(top, 6) as best_dice from d left join per using (rid)"""


def urls(rules: list[tuple[str, str]], pages: str = "pages", rounds: int = 10, damping: float = 0.85, ratio: float = 2.0) -> str:
    values = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in rules)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = ""
    for i in range(rounds):
        steps += f""",
m{i} as (select e.kind, e.dst as host, sum(share * rank) as moved from edges e join r{i} r on r.kind = e.kind and r.host = e.src group by all),
r{i + 1} as (select n.kind, n.host, {damping} * coalesce(moved, 0) + seed * (1 - {damping} * coalesce((select sum(moved) from m{i} x where x.kind = n.kind), 0)) as rank
  from nodes n left join m{i} m on m.kind = n.kind and m.host = n.host)"""
    return rf"""
with rules as (select * from (values {values}) v(action, rule, rhost, rpath)),
p0 as (select page_id, html, row_number() over () as rid, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from {pages}),
p as (select page_id, html, rid, {low.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p0),
ruled as (select p.*, rule, action from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  qualify row_number() over (partition by rid order by length(rule) desc, rule, action) = 1),
links as (select src, dst, count(*) as n from (select host as src, {low.format("unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"''>\\s]+)', 1))")} as dst from p where host <> '') where src <> dst group by all),
both_ways as (select 'trust' as kind, src, dst, n from links union all select 'distrust', dst, src, n from links),
edges as (select kind, src, dst, n / sum(n) over (partition by kind, src) as share from both_ways),
hosts as (select host, sum(t) as t, sum(b) as b from (select host, (action = 'allow')::int as t, (action = 'block')::int as b from ruled where host <> '' union all select dst, 0, 0 from links) group by host),
nodes as (select 'trust' as kind, host, coalesce(t, 0) / greatest((select coalesce(sum(t), 0) from hosts), 1) as seed from hosts
  union all select 'distrust', host, coalesce(b, 0) / greatest((select coalesce(sum(b), 0) from hosts), 1) from hosts),
r0 as (select kind, host, seed as rank from nodes){steps},
per as (select host, sum(rank) filter (kind = 'trust') as trust, sum(rank) filter (kind = 'distrust') as distrust from r{rounds} group by host)
select page_id, host, path, rule, coalesce(action, case when distrust * (select count(*) from hosts) > 1 and distrust > {ratio} * trust then 'block' else 'allow' end) as verdict,
  round(coalesce(trust, 0), 9) as trust, round(coalesce(distrust, 0), 9) as distrust
from ruled left join per using (host)"""


ORACLES["op9_license_bigrams"] = licenses()
ORACLES["op5_link_graph_propagation"] = urls([("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")])


def components(docs: str = "documents", shingle: int = 5, percent: int = 75) -> str:
    """Shared shingles of all pairs that have one, then reachability: for small tables. Equal sets are one node."""
    return rf"""
with recursive d as (select doc_id, row_number() over () as rid, regexp_extract_all({LOWER.format('text')}, '{SPACED}') as w from {docs}),
s as (select distinct rid, array_to_string(w[p : p + {shingle - 1}], ' ') as g from (select rid, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) as p from d where len(w) > 0)),
n as (select rid, count(*) as n, md5(string_agg(g, '|' order by g)) as sig from s group by rid),
rep as (select sig, min(rid) as r, any_value(n) as n from n group by sig),
rs as (select s.rid, s.g from s join rep on s.rid = rep.r),
pair as (select a.rid as x, b.rid as y, count(*) as o from rs a join rs b on a.g = b.g and a.rid <> b.rid group by all),
link as (select x, y from pair join rep p on p.r = x join rep q on q.r = y where 100 * o >= {percent} * (p.n + q.n - o)),
reach(x, y) as (select r, r from rep union select reach.x, link.y from reach join link on reach.y = link.x),
low as (select n.sig, min(doc_id) as m from n join d using (rid) group by n.sig),
comp as (select x, min(low.m) as c from reach join rep on rep.r = y join low using (sig) group by x)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, case when n.n is null then doc_id else comp.c end as component_id
from d left join n using (rid) left join rep using (sig) left join comp on comp.x = rep.r"""


ORACLES["op8_jaccard_signature_trees"] = components()


def infill(docs: str = "documents") -> str:
    return rf"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from {docs}),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1 : b], '') as middle, array_to_string(u[b + 1 :], '') as suffix from c),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output from p)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars, sha256(output) as output_sha256,
  sha256(case when form = 'plain' then output else prefix || middle || suffix end) as restored_sha256 from o"""


ORACLES["op12_fill_in_middle"] = infill()


def conversation_repair(turns: str = "conversations") -> str:
    """Costs and audits to go, from the last turn back, as strings of nine digits and edits, whose least is the cheapest
    and then the ASCII-least."""

    def add(cost: str, letter: str, after: str) -> str:
        return f"(printf('%09d', substr({after}, 1, 9)::bigint + {cost}) || '{letter}' || substr({after}, 10))"

    never = "'900000000'"

    def row(state: int) -> str:  # deletion, or keeping and reroling; new states by initial
        to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        new = "'a'" if to == 3 else "'u'"
        stay = add("3", "D", f"z.v{state}")
        kept = f"case when r.ini = {new} then {add('r.short', 'K', f'z.v{to}')}" + (f" when r.ini = 's' then {add('r.short', 'K', 'z.v1')}" if state == 0 else "") + f" else {never} end"
        return f"case when r.gone then {stay} else least({stay}, {kept}, {add('2 + r.short', 'R', f'z.v{to}')}) end"

    inserted = f"w0, w1, w2, w3, least(w2, {add('2', 'I', 'w3')}) as x2, least(w3, {add('2', 'I', 'w2')}) as x3"
    return rf"""
with recursive source as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from {turns}),
bytes as (select i::bigint as i, list_reduce(list_prepend(i::bigint, list_transform(range(8), lambda x: 0::bigint)), lambda c, b: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) t(i)),
lookup as (select list(v order by i) as v from bytes),
hashed as (select source.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c // 256, lookup.v[(xor(c, b) % 256) + 1]))) % 20 as h from source, lookup),
hurt as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from hashed, range(case when h = 3 then 2 else 1 end) where h <> 0),
conv as (select conv_id, row_number() over () as c from (select distinct conv_id from {turns})),
placed as (select c, turn, role, text, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i
  from hurt join conv on hurt.conv_id is not distinct from conv.conv_id),
seen as (select *, row_number() over (partition by c, role, text order by i) > 1 as again, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank from placed),
r as (select c, i, turn, role, text, role[1:1] as ini, blank, again and not blank as dup, blank or again as gone,
    (not blank and not again and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$'))::bigint as short,
    lag(role[1:1]) over (partition by c order by i) || role[1:1] as pair from seen),
totals as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(dup) as duplicate, sum(short) as truncated,
    count_if(pair is not null and pair not in ('su', 'ua', 'au')) as illegal, max(i) as n from r group by c),
z as (select c, n as i, '000000000' as v0, '000000004II' as v1, '000000002I' as v2, '000000000' as v3 from totals
  union all select c, i, least(w0, {add('2', 'I', 'x2')}), least(w1, {add('2', 'I', 'x2')}), x2, x3 from (select c, i, {inserted} from
    (select z.c, z.i - 1 as i, {', '.join(f'{row(s)} as w{s}' for s in range(4))} from z join r on r.c = z.c and r.i = z.i))),
best as (select c, substr(v0, 1, 9)::bigint as cost, substr(v0, 10) as audit from z where i = 0),
letters as (select c, p, audit[p:p] as e, length(audit[1:p]) - length(replace(audit[1:p], 'I', '')) as ins, length(audit[1:p]) - length(replace(audit[1:p], 'D', '')) as del,
    length(replace(audit, 'D', '')) as m from (select c, audit, unnest(range(1, length(audit) + 1)) as p from best)),
lines as (select l.c, l.p, case when e = 'K' then r.role when (p - del + m) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else r.text end as line
  from letters l left join r on r.c = l.c and r.i = l.p - l.ins and l.e <> 'I' where e <> 'D'),
joined as (select c, string_agg(line, chr(10) order by p) as body from lines group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from conv left join totals using (c) left join best using (c) left join joined using (c)"""


ORACLES["op11_conversation_repair"] = conversation_repair()
