"""Queries that apply rules: classification of names and questions, scopes, markers, admission of what models propose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import rules as R
from quillgraph.functions import strings as S
from quillgraph.operators import provenance as P
from quillgraph.operators import scope as SC
from quillgraph.plans.canonical import query


def lit(text: str) -> str:
    """A string as SQL has it."""
    return "'" + text.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({text}, '')), '’', chr(39)), {lit(R.WORD)})"


def sql_has(text: str, phrases: list[str]) -> str:
    """Whether a text has one of the phrases, as a regular expression over its words with single blanks."""
    step = lambda x: {"_": "[^ ]+", "#": "[0-9][^ ]*"}.get(x) or (x[:-1] + "[^ ]*" if x.endswith("*") else "(" + x.replace("/", "|") + ")")
    every = "|".join(" ".join(map(step, p.split())) for p in phrases)
    return f"regexp_matches(' ' || array_to_string({sql_words(text)}, ' ') || ' ', {lit(f' ({every}) ')})"


# Names and titles ----------------------------------------------------------------------------------------------------

_ALNUM = "regexp_full_match({}, '[A-Z][A-Za-z0-9]*')"
_ANY = lambda values: "(" + "|".join(values) + ")"
_COMMAND = f"""(len(list_filter(range(1, len(ws) + 1), lambda i: list_contains({words(R.COMMANDS)}, ws[i]) and regexp_matches(ws[i + 1], '^[a-z]') or list_contains({words(R.COMMAND_VERBS)}, split_part(ws[i], '-', 1)) and regexp_matches(split_part(ws[i], '-', 2), '^[A-Z]')
    or starts_with(ws[i], '--') and regexp_matches(ws[i], '^..[a-z]'))) > 0 or contains(n, '`') or regexp_matches(n, '[$][A-Za-z_]'))"""
_KINDS = {
    "blank": "n = ''",
    "arn": "starts_with(lower(n), 'arn:')",
    "resource_id": f"list_contains({words(R.RESOURCE_PREFIXES)}, lower(split_part(n, '-', 1))) and regexp_full_match(n, '[^-]*-[A-Za-z0-9]{{6,}}')",
    "org_id": f"list_contains({words(R.ORGANISATION_PREFIXES)}, lower(split_part(n, '-', 1))) and regexp_full_match(n, '[^-]*-[A-Za-z0-9-]+') and regexp_matches(n, '[0-9]')",
    "number": "length(n) > 5 and regexp_full_match(n, '[0-9]*')",
    "invalid_code": f"starts_with(n, 'Invalid') and {_ALNUM.format('n')} and regexp_matches(n[8:8], '[A-Z]')",
    "command": _COMMAND,
    "region": "lower(split_part(n, ' ', -1)) in ('region', 'regions')",
    "service_action": "regexp_full_match(n, '[a-z][a-z0-9]{1,20}:[A-Za-z][A-Za-z0-9-]*')",
    "api_field": f"{_ALNUM.format('n')} and regexp_matches(n, '.{_ANY(R.FIELD_ENDINGS)}$')",
    "document_title": f"regexp_matches(n, '(^|[^A-Za-z0-9_]){_ANY(R.TITLE_ENDINGS)}$')",
    "api_id": f"{_ALNUM.format('n')} and regexp_matches(n, '[a-z]{_ANY(R.ID_ENDINGS)}$') and not list_contains({words(R.NOT_IDS)}, n)",
}


#: The kind of noise of each entity, or `kept`.
_RULES = " ".join(f"when {_KINDS[n]} then {lit(n)}" for n, _ in R.NOISE)
NOISE = rf"(select entity_id, case {_RULES} else 'kept' end as rule from (select entity_id, trim(name) as n, string_split_regex(trim(name), '\s+') as ws from entity_name))"


@query("flt_5_noise_classifier", f"select entity_id, rule from {NOISE}")
def _(t):
    return t.entity_name.select("entity_id", F.coalesce(R.noise(F.col("name")), F.lit("kept")).alias("rule"))


@query("flt_6_navigation_articles", f"select article_id, title from page_title where {sql_has('title', R.NAVIGATION)}")
def _(t):
    return t.page_title.filter(R.is_navigation(F.col("title"))).select("article_id", "title")


REGION_KEYS = f"""e as (select entity_id, list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x <> '') as w from entity_name), v as (select entity_id, case when len(w) > 1 and list_contains({words(R.CLOUD_WORDS)}, w[1]) then w[2:] else w end as w from e),
    k as (select entity_id, array_to_string(case when len(w) > 1 and w[-1] in ('region', 'regions') then w[:-2] else w end, ' ') as key from v)"""


@query("flt_8_region_gazetteer", f"with {REGION_KEYS} select entity_id, key from k where key in (select key from gazetteer)")
def _(t):
    """Entities whose names are regions of a gazetteer, a table of the caller."""
    return t.entity_name.select("entity_id", R.region_key(F.col("name")).alias("key")).join(t.gazetteer, "key", "left_semi").select("entity_id", "key")


@query("flt_9_limitations", f"select doc_id, {sql_has('text', R.LIMITATION)} as limitation from documents")
def _(t):
    return t.documents.select("doc_id", R.is_limitation(F.col("text")).alias("limitation"))


_PLURAL = f"(regexp_matches({{w}}, '[^suia]s$') and length({{w}}) > 3 and not list_contains({words(R.HELPERS)}, {{w}}) or regexp_matches({{w}}, '[a-z][a-z]as$'))"
_ASKS = f"""len(list_filter(range(2, 6), lambda i: {_PLURAL.format(w='w[i]')} and (list_contains({words(R.HELPERS)}, w[i + 1]) or w[i + 1] = 'is' and w[i + 2] = 'supported'))) > 0"""
_ITEM = lambda k: f"coalesce({_PLURAL.format(w=f'w[{k}]')} and not list_contains({words(R.NO_ITEMS)}, w[{k}]), false)"


@query("flt_10_list_questions", f"""with s as (select question_id, {sql_words('q')} as w from question)
    select question_id from s where coalesce(w[1] in ('which', 'what') and {_ASKS}, false) and not coalesce(w[1] in ('which', 'what') and list_contains({words(R.SINGLE_ANSWER)}, w[2]), false)
      or coalesce(array_to_string(w[1:3], ' ') = 'what are the', false) and ({_ITEM(4)} or {_ITEM(5)}) and not list_contains({words(R.NO_ITEMS)}, coalesce(w[4], ''))
      or coalesce(w[1] = 'list' or w[1] = 'where' and w[2] = 'can' and w[3] in ('i', 'you', 'we') or w[1] = 'supported' and {_PLURAL.format(w='w[2]')}, false)""")
def _(t):
    return t.question.filter(R.is_list_question(F.col("q"))).select("question_id")


@query("flt_11_cross_vendor_wording", f"select question_id, {sql_has('q', R.CROSS_VENDOR)} as across from question")
def _(t):
    return t.question.select("question_id", R.is_cross_vendor(F.col("q")).alias("across"))


_SCOPE_WORDS = "regexp_extract_all(lower(vendor || ' ' || product), '[a-z0-9][a-z0-9_-]*')"


@query("txt_question_terms", f"""select question_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(q), '[a-z0-9][a-z0-9_-]*')), lambda w: not list_contains({words(R.STOPWORDS)}, w) and not list_contains({_SCOPE_WORDS}, w))), ' ') as terms from question""")
def _(t):
    drop = F.regexp_extract_all(F.lower(F.concat("vendor", F.lit(" "), "product")), F.lit(r"[a-z0-9][a-z0-9_-]*"), F.lit(0))
    return t.question.select("question_id", F.array_join(F.array_sort(R.question_terms(F.col("q"), drop)), " ").alias("terms"))


_STEM = "case " + " ".join(
    f"when ends_with({{w}}, '{s}') and length({{w}}) - {len(s)} + {int(s == 'ies')} >= 4 then left({{w}}, length({{w}}) - {len(s)}) || '{'y' if s == 'ies' else ''}'" for s in R.SUFFIXES
) + " else {w} end"


@query("txt_word_forms", f"""with w as (select distinct unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) as w from question union select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) from benchmark),
    b as (select w, ends_with(w, 's') and length(w) > 4 as single from w), c as (select w, single, case when single then left(w, length(w) - 1) else w end as base from b),
    d as (select *, {_STEM.format(w='base')} as bare from c)
    select w, array_to_string(list_sort(list_distinct([w, case when single then base when regexp_matches(w, '(s|x|z|ch|sh)$') then w || 'es' else w || 's' end] || case when bare <> base then [bare || 'ed', bare || 'ing'] else []::varchar[] end)), ' ') as forms from d""")  # fmt: skip
def _(t):
    w = t.question.select(F.explode(F.regexp_extract_all(F.lower("q"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    w = w.unionByName(t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))).distinct()
    return w.select("w", F.array_join(F.array_sort(R.word_forms(F.col("w"))), " ").alias("forms"))


# Questions: mode, scope, shape -----------------------------------------------------------------------------------------

_SAID = "case question_id % 5 when 0 then ' Local.' when 1 then 'drift or global' when 2 then 'unsure' end"
_OVER = "case when question_id % 17 = 0 then 'timeline' when question_id % 19 = 0 then 'bogus' end"


@query("ret_11_routing", f"""select question_id, case when {_OVER} in ('local', 'global', 'drift', 'timeline') then {_OVER} when {sql_has('q', R.TEMPORAL)} then 'timeline' when {sql_has('q', R.COMPARING)} then 'global'
    when contains(lower({_SAID}), 'local') then 'local' when contains(lower({_SAID}), 'global') then 'global' when contains(lower({_SAID}), 'drift') then 'drift' when contains(lower({_SAID}), 'timeline') then 'timeline' else 'drift' end as mode from question""")  # fmt: skip
def _(t):
    return t.question.select("question_id", R.mode(F.col("q"), F.expr(_OVER), F.expr(_SAID)).alias("mode"))


@query("ret_15_mode_fallback", """with r as (select user_id, case user_id % 4 when 0 then 'local' when 1 then 'global' when 2 then 'drift' else 'timeline' end as mode, count(*) filter (event_type = 'view') as retrieved, count(*) filter (value > 480) as citations,
      count(*) filter (event_type = 'click') as used, user_id % 3 as facets from events group by user_id)
    select user_id, case when mode = 'local' and retrieved = 0 then 'drift' when mode = 'global' and (citations = 0 or (facets < 2 and used = 0)) then 'local' else mode end as mode,
      case when mode = 'local' and retrieved = 0 or mode = 'global' and (citations = 0 or (facets < 2 and used = 0)) then mode end as fallback_from from r""")
def _(t):
    """Local search that retrieved nothing goes on as drift; a global one that grounded nothing as local. With two facets
    or more, only a missing citation counts."""
    kinds = ["local", "global", "drift", "timeline"]
    r = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("retrieved"), F.count_if(F.col("value") > 480).alias("citations"), F.count_if(F.col("event_type") == "click").alias("used"))
    r = r.withColumn("mode", F.get(F.array(*map(F.lit, kinds)), (F.col("user_id") % 4).cast("int"))).withColumn("facets", F.col("user_id") % 3)
    empty = (F.col("mode") == "local") & (F.col("retrieved") == 0)
    bare = (F.col("mode") == "global") & ((F.col("citations") == 0) | ((F.col("facets") < 2) & (F.col("used") == 0)))
    return r.select("user_id", F.when(empty, "drift").when(bare, "local").otherwise(F.col("mode")).alias("mode"), F.when(empty | bare, F.col("mode")).alias("fallback_from"))


_TERMS = rf"""once as (select lower(name) as key, min(name) as name, min(vendor) as vendor from docset group by 1 having count(*) = 1),
    known as (select lower(vendor) as key, 1 as rank, 'vendor' as kind, vendor as name, true as seen from vendor union all select lower(product), 2, 'product', product, true from product union all select key, 3, 'source', name,
      contains(key, lower(vendor)) and len(list_filter(regexp_extract_all(replace(key, lower(vendor), ' '), '[\w&+.-]+'), lambda w: not list_contains({words(SC.GENERIC)}, w))) > 0 from once),
    target as (select distinct lower(alias) as key, kind, name from alias join (select * from known qualify row_number() over (partition by key order by rank) = 1) b on b.key = lower(trim(target))),
    term as (select key, list_sort(list(kind || ':' || name)) as targets from target group by key union all
      select key, [kind || ':' || name] from (select * from known where seen qualify row_number() over (partition by key order by rank) = 1) where key not in (select key from target)),"""
_MENTIONS = rf"""{_TERMS}
    place as (select question_id, q, key, targets, unnest(range(1, length(q) + 1)) as p from question join term on contains(lower(q), key)),
    occ as (select question_id, q, p as a, p + length(key) as b, targets from place where substr(lower(q), p, length(key)) = key and (p = 1 or not regexp_matches(substr(q, p - 1, 1), '[\w-]')) and not regexp_matches(substr(q, p + length(key), 1), '\w')),
    longest as (select * from occ qualify row_number() over (partition by question_id, a order by b desc) = 1),
    nxt as (select l.question_id, l.a, min(x.a) as na from longest l left join longest x on x.question_id = l.question_id and x.a >= l.b group by 1, 2),
    keep(question_id, a) as (select question_id, min(a) from longest group by 1 union all select n.question_id, n.na from keep k join nxt n on n.question_id = k.question_id and n.a = k.a where n.na is not null),
    named as (select l.* from keep join longest l using (question_id, a)),"""


def _terms(t):
    known = SC.names(t.vendor.select("vendor"), t.product.select("product"), t.docset.select("name", "vendor"))
    return known, SC.terms(known, t.alias)


@query("join_28_alias_resolution", f"with recursive {_TERMS} x as (select 1) select key, kind, name from target")
def _(t):
    """Each alias with its known targets; of a vendor and a product of one name, the vendor."""
    return SC.alias_targets(_terms(t)[0], t.alias)


@query("ret_13_scope_resolution", f"""with recursive {_MENTIONS} t as (select distinct question_id, unnest(targets) as t from named where not {sql_has('q', R.CROSS_VENDOR)})
    select question_id, split_part(t, ':', 1) as kind, substr(t, position(':' in t) + 1) as name from t""")
def _(t):
    return SC.detected(t.question, _terms(t)[1])


@query("txt_mentions", f"""with recursive {_MENTIONS} x as (select 1) select question_id, a - 1 as start, b - 1 as "end", array_to_string(targets, ',') as targets from named""")
def _(t):
    m = SC.mentions(t.question, _terms(t)[1])
    return m.select("question_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.array_join(F.transform("targets", lambda x: F.concat(x["kind"], F.lit(":"), x["name"])), ",").alias("targets"))


@query("ret_12_question_shape", f"""with recursive {_MENTIONS} t as (select question_id, targets, unnest(targets) as t from named),
    of as (select 'product:' || product as t, vendor from product join vendor using (vendor_id) union all select 'source:' || name, vendor from once),
    cov as (select question_id, list(distinct vendor) as c from t join of using (t) group by 1),
    side as (select question_id, count(*) filter (not (len(list_filter(targets, lambda x: not starts_with(x, 'vendor:'))) = 0 and len(list_filter(targets, lambda x: not list_contains(coalesce(c, []), substr(x, 8)))) = 0)) as n
      from (select distinct question_id, targets from named) left join cov using (question_id) group by 1),
    opened as (select n.question_id, q, n.b, {sql_words('substr(q, 1, n.a - 1)')} as w from named n),
    subject as (select distinct question_id from opened s where list_contains({words(['is', 'was', 'has', 'have', *R.HELPERS])}, w[-1]) and w[-2] in ('vendor', 'vendors') and (w[-3] in ('which', 'what') or w[-4] in ('which', 'what') or w[-5] in ('which', 'what'))
      and not exists (select 1 from named o where o.question_id = s.question_id and o.a > s.b and trim(lower(substr(s.q, s.b, o.a - s.b)), ' ,') in ('and', 'or')))
    select question_id, case when {sql_has('q', R.CROSS_VENDOR)} and question_id in (select question_id from subject) then 'single' when {sql_has('q', R.CROSS_VENDOR)} then 'enumeration' when coalesce(n, 0) >= 2 then 'comparison' else 'single' end as shape,
      coalesce(n, 0)::bigint as sides from question left join side using (question_id)""")  # fmt: skip
def _(t):
    known, found = _terms(t)
    of = t.product.join(t.vendor, "vendor_id").select(F.lit("product").alias("kind"), F.col("product").alias("name"), "vendor")
    once = t.docset.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.min("vendor").alias("vendor"), F.count("*").alias("n")).filter("n = 1")
    of = of.unionByName(once.select(F.lit("source").alias("kind"), "name", "vendor"))
    return SC.shape(t.question, found, of).withColumn("sides", F.col("sides").cast("long"))


# Markers -----------------------------------------------------------------------------------------------------------------

_PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"
_COUNTS = rf"""m as (select answer_id, text, {_PARTS} as p from answer),
    c as (select answer_id, list_transform(p, lambda s: len(regexp_extract_all(replace(s, ',', '][ '), '[0-9]+'))) as n, list_transform(p, lambda s: len(regexp_extract_all(regexp_extract(s, '^(?:\[[0-9]+\]\s*)+'), '[0-9]+'))) as lead from m),
    k as (select answer_id, list_filter(list_transform(range(1, len(n) + 1), lambda i: n[i] - case when i > 1 then lead[i] else 0 end + coalesce(lead[i + 1], 0)), lambda x: x > 0) as k from c)"""


@query("win_17_markers_per_sentence", f"with {_COUNTS} select answer_id, array_to_string(k, ',') as counts from k")
def _(t):
    n = F.transform(R.markers_per_sentence(R.single_markers(F.col("text"))), lambda x: x.cast("string"))
    return t.answer.select("answer_id", F.array_join(n, ",").alias("counts"))


@query("agg_34_bag_share", f"with {_COUNTS} select answer_id, round(list_sum(list_filter(k, lambda x: x >= 8)) / nullif(list_sum(k), 0), 6) as share from k where list_sum(k) > 0 and len(list_filter(k, lambda x: x >= 8)) > 0 union all select answer_id, case when list_sum(k) > 0 then 0.0 end from k where not coalesce(len(list_filter(k, lambda x: x >= 8)) > 0, false)")
def _(t):
    return t.answer.select("answer_id", F.round(R.bag_share(R.single_markers(F.col("text"))), 6).alias("share"))


@query("join_23_marker_citations", """with m as (select answer_id, size, unnest(regexp_extract_all(text, '[0-9]+'))::int as marker, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) as pos from answer),
    f as (select answer_id, size, marker, min(pos) as pos from m where marker between 1 and 8 group by all)
    select answer_id, marker, row_number() over (partition by answer_id order by pos) as place, c.claim_id, vendor, product from f join claim_scope c on c.claim_id = f.size + f.marker""")
def _(t):
    """Markers that the map knows, in order of appearance, each once, with what they cite and where that is from."""
    numbers = R.marker_numbers(R.single_markers(F.col("text")))
    cited = P.cited(t.answer.select("answer_id", "size", numbers.alias("numbers")), t.claim_scope.select("claim_id", "vendor", "product"), 8)
    return cited.select("answer_id", "marker", F.col("place").cast("long").alias("place"), "claim_id", "vendor", "product")


@query("txt_strip_markers", r"""with s as (select answer_id, regexp_replace(regexp_replace(text, '\[([0-9]+), ([0-9]+)\]', '[\1] [\2]', 'g'), '\[([0-9]+)\]', '[\1]', 'g') as text from answer),
    p as (select answer_id, string_split_regex(text, '\[[0-9]+\]') as p, regexp_extract_all(text, '\[([0-9]+)\]', 1) as m from s),
    j as (select answer_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || case when m[i] is null then '' when m[i]::int between 1 and 4 then '[' || m[i] || ']' else chr(1) end), '') as t from p),
    k as (select answer_id, regexp_replace(regexp_replace(t, '[ \t]*\x01[ \t]*', ' ', 'g'), '([^ \t\n])[ \t][ \t]+', '\1 ', 'g') as t from j)
    select answer_id, trim(regexp_replace(t, '[ \t]+([.,;:!?])', '\1', 'g')) as text from k""")
def _(t):
    return t.answer.select("answer_id", S.strip_markers(R.single_markers(F.col("text")), F.array(*map(F.lit, (1, 2, 3, 4)))).alias("text"))


# Admission ---------------------------------------------------------------------------------------------------------------


@query("flt_21_edge_acceptance", """with p as (select call_id, pos, src, dst, quoted, relation, least(src, dst) as a, greatest(src, dst) as b, src in (select product_id from product) and dst in (select product_id from product) as listed from proposed_edge),
    h as (select p.*, exists (select 1 from call_edge e where e.call_id = p.call_id and least(e.src, e.dst) = a and greatest(e.src, e.dst) = b) as have from p),
    f as (select *, min(pos) filter (listed and src <> dst and not have and quoted and relation <> 'N') over (partition by call_id, a, b) as first from h)
    select call_id, pos, case when not listed then 'entity_not_listed' when src = dst then 'self_loop' when have or pos > first then 'pair_already_present' when not quoted then 'quote_not_found' when relation = 'N' then 'schema' else 'accepted' end as verdict from f""")
def _(t):
    """A pair is present if the reply has it, in either direction, or an earlier proposal of it was accepted."""
    known = t.product.select(F.col("product_id").alias("n"), F.lit(True).alias("k"))
    p = t.proposed_edge.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    for end in ("src", "dst"):
        p = p.join(known.withColumnsRenamed({"n": end, "k": f"k_{end}"}), end, "left")
    have = t.call_edge.select("call_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(True).alias("have")).distinct()
    p = p.join(have, ["call_id", "a", "b"], "left").withColumn("listed", F.col("k_src").isNotNull() & F.col("k_dst").isNotNull()).withColumn("have", F.col("have").isNotNull())
    ok = F.col("listed") & (F.col("src") != F.col("dst")) & ~F.col("have") & F.col("quoted") & (F.col("relation") != "N")
    first = p.filter(ok).groupBy("call_id", "a", "b").agg(F.min("pos").alias("first"))
    p = p.join(first, ["call_id", "a", "b"], "left")
    verdict = F.when(~F.col("listed"), "entity_not_listed").when(F.col("src") == F.col("dst"), "self_loop").when(F.col("have") | (F.col("pos") > F.col("first")), "pair_already_present")
    return p.select("call_id", "pos", verdict.when(~F.col("quoted"), "quote_not_found").when(F.col("relation") == "N", "schema").otherwise("accepted").alias("verdict"))


_USABLE = """l as (select event_id, user_id, n, list_transform(json_extract(j, '$.labels[*].n'), lambda x: x::int) as ns, json_extract_string(j, '$.labels[*].verdict') as vs from (select *, case when json_valid(reply) then reply else '{}' end as j from label_reply)),
    u as (select *, len(ns) = n and list_sort(ns) = range(1, n + 1)::int[] and len(list_filter(vs, lambda v: v not in ('stated', 'unsupported'))) = 0 as usable from l)"""


def _labels(t):
    labels = F.from_json("reply", "labels array<struct<n:int,verdict:string>>")["labels"]
    ns = F.array_sort(F.transform("l", lambda x: x["n"]))
    usable = (F.size("l") == F.col("n")) & (ns == F.sequence(F.lit(1), F.col("n"))) & F.forall("l", lambda x: x["verdict"].isin("stated", "unsupported"))
    return t.label_reply.withColumn("l", labels).select("event_id", "user_id", "n", "l", F.coalesce(usable, F.lit(False)).alias("usable"))


@query("flt_22_strict_labels", f"""with {_USABLE} select event_id, usable, case when usable then array_to_string(list_sort(list_transform(list_filter(list_zip(ns, vs), lambda z: z[2] = 'unsupported'), lambda z: z[1])), ',') else '' end as dropped from u""")
def _(t):
    """Exactly the labels 1 to n with known verdicts, else the reply is of no use and drops nothing."""
    bad = F.array_sort(F.transform(F.filter("l", lambda x: x["verdict"] == "unsupported"), lambda x: x["n"]))
    return _labels(t).select("event_id", "usable", F.when(F.col("usable"), F.array_join(F.transform(bad, lambda x: x.cast("string")), ",")).otherwise("").alias("dropped"))


@query("agg_47_two_pass_labels", f"""with {_USABLE}, x as (select event_id, user_id, n, unnest(list_zip(ns, vs)) as z from u where usable),
    pass as (select user_id, n, z[1] as k, z[2] as verdict, row_number() over (partition by user_id, n, z[1] order by event_id) as p from x),
    two as (select a.user_id, a.n, a.k, a.verdict = 'unsupported' and b.verdict = 'unsupported' as bad from pass a join pass b on a.user_id = b.user_id and a.n = b.n and a.k = b.k and a.p = 1 and b.p = 2)
    select user_id, n, count(*) filter (bad) as n_bad, count(*) filter (bad) > 0 and count(*) filter (bad) < n as pair from two group by user_id, n""")
def _(t):
    """Facts that two passes of labels over one reply (a user and a number of facts) both call unsupported; a pair is
    built unless none or all are."""
    x = _labels(t).filter("usable").select("event_id", "user_id", "n", F.explode("l").alias("z")).select("event_id", "user_id", "n", F.col("z.n").alias("k"), "z.verdict")
    w = Window.partitionBy("user_id", "n", "k").orderBy("event_id")
    two = x.withColumn("p", F.row_number().over(w)).filter("p <= 2").groupBy("user_id", "n", "k").agg(F.count("*").alias("c"), F.bool_and(F.col("verdict") == "unsupported").alias("bad")).filter("c = 2")
    bad = F.count_if("bad")
    return two.groupBy("user_id", "n").agg(bad.alias("n_bad"), ((bad > 0) & (bad < F.first("n"))).alias("pair"))


@query("flt_16_judgement_shape", """select event_id, json_array_length(record, '$.gold') = n_gold and json_type(record, '$.citations_ok') = 'BOOLEAN' and json_type(record, '$.abstained') = 'BOOLEAN' as valid from judgement""")
def _(t):
    j = F.from_json("record", "gold array<boolean>, citations_ok boolean, abstained boolean")
    ok = (F.size(j["gold"]) == F.col("n_gold")) & F.forall(j["gold"], lambda g: g.isNotNull()) & j["citations_ok"].isNotNull() & j["abstained"].isNotNull()
    return t.judgement.select("event_id", F.coalesce(ok, F.lit(False)).alias("valid"))


@query("flt_17_question_violations", """with q as (select question_id, size, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) as key from question)
    select question_id, 'duplicate' as rule from q qualify row_number() over (partition by key order by question_id) > 1 union all select question_id, 'not_in_corpus' from q where question_id not in (select doc_id from documents)
    union all select question_id, 'too_many_facts' from q where size > 40 union all select question_id, 'no_text' from q where key = ''""")
def _(t):
    q = t.question.select("question_id", "size", S.fact_text_key(F.col("q")).alias("key"))
    first = q.groupBy("key").agg(F.min("question_id").alias("first"))
    twice = q.join(first, "key").filter("question_id > first").select("question_id", F.lit("duplicate").alias("rule"))
    unknown = q.join(t.documents.select(F.col("doc_id").alias("question_id")), "question_id", "left_anti").select("question_id", F.lit("not_in_corpus").alias("rule"))
    many = q.filter("size > 40").select("question_id", F.lit("too_many_facts").alias("rule"))
    return twice.unionByName(unknown).unionByName(many).unionByName(q.filter("key = ''").select("question_id", F.lit("no_text").alias("rule")))


@query("flt_20_unnamed_subjects", """with c as (select claim_id, p.product as own, s.product as subject, lower(coalesce(text, '') || case when claim_id % 3 = 0 then ' ' || s.product else '' end) as text
      from claim join source using (source_id) join product p on p.product_id = source.product_id join product s on s.product_id = claim.subject)
    select claim_id from c where lower(own) <> lower(subject) and not contains(text, lower(subject))""")
def _(t):
    """A fact whose subject is the product of other documents, and isn't named in its text."""
    s = t.product.select(F.col("product_id").alias("subject"), F.col("product").alias("name"))
    c = t.claim.join(t.source.select("source_id", "product_id"), "source_id").join(t.product.select("product_id", "product"), "product_id").join(s, "subject")
    text = F.lower(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("claim_id") % 3 == 0, F.concat(F.lit(" "), "name")).otherwise("")))
    return c.filter((F.lower("product") != F.lower("name")) & ~F.contains(text, F.lower("name"))).select("claim_id")


@query("flt_24_parity_guards", """with e as (select 'facts' as metric, count(*) as expected from (select distinct l_orderkey, l_partkey from lineitem) union all select 'episodes', count(*) from lineitem union all select 'entities', count(*) from part),
    a as (select 'facts' as metric, count(*) as actual from fact union all select 'episodes', count(distinct episode_id) from fact_episode union all select 'mentions', count(*) from mention)
    select metric, expected, actual, expected is not distinct from actual as same, bool_or(expected is distinct from actual) over () as refuse from e full join a using (metric)""")
def _(t):
    """What a run was made with against what is there now; any difference, or a value on one side only, refuses."""
    count = lambda df, name: df.agg(F.count("*").alias("v")).select(F.lit(name).alias("metric"), "v")
    e = count(t.lineitem.select("l_orderkey", "l_partkey").distinct(), "facts").unionByName(count(t.lineitem, "episodes")).unionByName(count(t.part, "entities")).withColumnRenamed("v", "expected")
    a = count(t.fact, "facts").unionByName(count(t.fact_episode.select("episode_id").distinct(), "episodes")).unionByName(count(t.mention, "mentions")).withColumnRenamed("v", "actual")
    both = e.join(a, "metric", "full_outer").withColumn("same", F.col("expected").eqNullSafe(F.col("actual")))
    return both.withColumn("refuse", F.bool_or(~F.col("same")).over(Window.partitionBy(F.lit(1))))  # of four rows


_SAYS = "case when event_type = 'view' and event_id % 2 = 0 then '  ' else event_type || ' ' || event_id end"
_RELEVANCE = "case event_id % 5 when 0 then 'high' when 1 then '' else cast(cast(floor(value) as int) as varchar(20)) end"


@query("flt_26_follow_ups", f"""with hit as (select distinct user_id % 50 as c from events where event_type = 'purchase'), f as (select user_id, event_id, trim({_SAYS}) as q, coalesce(try_cast({_RELEVANCE} as double), 0) as r, event_id % 50 as c from events)
    select user_id, event_id, case when c in (select c from hit) then c end as community, row_number() over (partition by user_id order by r desc, event_id) as place from f where q <> '' qualify place <= 3""")
def _(t):
    """Questions that aren't blank, the three most relevant of each round (no number: 0); a community only if it was hit."""
    hit = t.events.filter("event_type = 'purchase'").select((F.col("user_id") % 50).alias("c")).distinct().withColumn("hit", F.lit(True))
    f = t.events.select("user_id", "event_id", F.trim(F.expr(_SAYS)).alias("q"), F.coalesce(F.expr(f"try_cast({_RELEVANCE} as double)"), F.lit(0.0)).alias("r"), (F.col("event_id") % 50).alias("c")).filter("q <> ''")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("r"), "event_id")).cast("long")
    return f.withColumn("place", place).filter("place <= 3").join(hit, "c", "left").select("user_id", "event_id", F.when(F.col("hit"), F.col("c")).alias("community"), "place")


_NAME = "case l_suppkey % 5 when 0 then 'Air' when 1 then 'Rail' when 2 then 'Truck' when 3 then 'Ship' else 'Mail' end"
_ITEM = f"case when l_linenumber = 4 then ' *' when l_linenumber % 2 = 0 then upper({_NAME}) || ': ' else '  ' || lower({_NAME}) end"


@query("flt_27_new_entries", rf"""with e as (select l_orderkey as answer, l_linenumber as pos, (l_linenumber, l_partkey, l_suppkey) as spot, lower(rtrim(trim(regexp_replace({_ITEM}, '\s+', ' ', 'g')), ' :*')) as key, [l_partkey % 10, l_suppkey % 10, l_linenumber] as ms from lineitem),
    k as (select answer, pos, spot, key, list_filter(ms, lambda x, i: x % 2 = answer % 2 and list_position(ms, x) = i) as kept from e),
    ok as (select * from k where key <> '' and len(kept) > 0 and not (answer % 3 = 0 and key = 'air') and not (answer % 3 = 1 and key = 'rail') qualify row_number() over (partition by answer, key order by spot) = 1)
    select answer, pos, key, array_to_string(kept[1:3], ',') as markers from ok qualify row_number() over (partition by answer order by spot) <= 2""")
def _(t):
    """Entries with a name that the answer doesn't list yet, and with markers that it doesn't cite yet; of one name the
    first such, two of an answer, in order."""
    key = F.lower(F.rtrim(F.trim(F.regexp_replace(F.expr(_ITEM), r"\s+", " ")), F.lit(" :*")))
    marks = F.array_distinct(F.array(F.col("l_partkey") % 10, F.col("l_suppkey") % 10, F.col("l_linenumber").cast("long")))
    kept = F.filter(marks, lambda x: x % 2 == F.col("l_orderkey") % 2)
    e = t.lineitem.select(F.col("l_orderkey").alias("answer"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.col("l_linenumber").alias("pos"), key.alias("key"), kept.alias("kept"))
    listed = t.orders.select(F.col("o_orderkey").alias("answer"), F.when(F.col("o_orderkey") % 3 == 0, "air").when(F.col("o_orderkey") % 3 == 1, "rail").alias("key"))
    ok = e.filter((F.col("key") != "") & (F.size("kept") > 0)).join(listed, ["answer", "key"], "left_anti")
    ok = ok.groupBy("answer", "key").agg(F.min_by(F.struct("at", "pos", "kept"), "at").alias("e")).select("answer", "key", "e.*")
    rn = F.row_number().over(Window.partitionBy("answer").orderBy("at"))
    return ok.withColumn("rn", rn).filter("rn <= 2").select("answer", "pos", "key", F.array_join(F.transform(F.slice("kept", 1, 3), lambda x: x.cast("string")), ",").alias("markers"))


@query("flt_28_sanitised_citations", """with f as (select l_orderkey as report, l_linenumber as finding, unnest([l_partkey % 50, l_suppkey % 50, l_partkey % 50]) as id, generate_subscripts([1, 2, 3], 1) as pos from lineitem where l_linenumber <> 3),
    ok as (select report, id, min(finding * 10 + pos) as place from f where id % 3 <> report % 3 group by all) select report, string_agg(cast(id as varchar), ',' order by place, id) as cited from ok group by report""")
def _(t):
    """Facts that a report's findings cite, of those that its context has, each once and in order; the third finding was
    dropped, and what it alone cites goes with it."""
    f = t.lineitem.filter("l_linenumber <> 3").select(F.col("l_orderkey").alias("report"), "l_linenumber", F.posexplode(F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50, F.col("l_partkey") % 50)).alias("pos", "id"))
    ok = f.filter(F.col("id") % 3 != F.col("report") % 3).groupBy("report", "id").agg(F.min(F.struct("l_linenumber", "pos")).alias("place"))
    cited = F.array_sort(F.collect_list(F.struct("place", "id")))  # a report cites what its context holds: a bounded list
    return ok.groupBy("report").agg(F.array_join(F.transform(cited, lambda x: x["id"].cast("string")), ",").alias("cited"))
