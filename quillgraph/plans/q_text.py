"""Text and scalar queries: normal forms, markers, chunks, pages, hashes, JSON, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import rules as RU
from quillgraph.functions import strings as S
from quillgraph.operators import chunking as C
from quillgraph.operators import grounding as GR
from quillgraph.plans.canonical import query

MARKED = "concat('see [', cast(p_size as varchar), ', ', cast(p_partkey % 9 as varchar), '] and [', cast(p_partkey % 5 as varchar), '].')"


def _marked():
    return F.concat(F.lit("see ["), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_partkey") % 9).cast("string"), F.lit("] and ["), (F.col("p_partkey") % 5).cast("string"), F.lit("]."))


@query("txt_fact_key", "select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as key from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(S.fact_text_key(F.col("text"))).alias("key"))


@query("txt_name_key", "select p_partkey, lower(trim(regexp_replace('  ' || p_name || '  ', '\\s+', ' ', 'g'))) as key from part")
def _(t):
    return t.part.select("p_partkey", S.name_key(F.concat(F.lit("  "), "p_name", F.lit("  "))).alias("key"))


@query("txt_token_counts", "select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n_distinct from documents")
def _(t):
    w = S.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


_SUFFIXES = ("s", "es", "ed", "ing", "ation", "ations")


@query("txt_stems", "with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents) select w, case " + " ".join(
    f"when w like '%{s}' and length(w) - {len(s)} >= 4 then left(w, length(w) - {len(s)})" for s in reversed(_SUFFIXES)) + " else w end as stem from w")
def _(t):
    words = t.documents.select(F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("w")).distinct()
    return words.select("w", S.stem(F.col("w")).alias("stem"))


@query("txt_approx_tokens", "select source, cast(sum(floor(length(text) / 4)) as bigint) as tokens from documents group by source")
def _(t):
    return t.documents.groupBy("source").agg(F.sum(S.approx_tokens(F.col("text"))).alias("tokens"))


@query("txt_markers", f"select p_partkey, array_to_string(regexp_extract_all({MARKED}, '[0-9]+'), ',') as markers from part")
def _(t):
    numbers = F.transform(S.markers(S.expand_marker_lists(_marked())), lambda x: x.cast("string"))
    return t.part.select("p_partkey", F.array_join(numbers, ",").alias("markers"))


@query("txt_unknown_markers", f"with m as (select p_partkey, unnest(regexp_extract_all({MARKED}, '[0-9]+'))::int as n from part) select n as marker, count(*) as uses from m where n > 20 group by n")
def _(t):
    m = t.part.select(F.explode(S.markers(S.expand_marker_lists(_marked()))).alias("marker"))
    return m.filter("marker > 20").groupBy("marker").agg(F.count("*").alias("uses"))


@query("txt_page_title", "select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title from pages")
def _(t):
    return t.pages.select("page_id", S.page_title(F.col("html")).alias("title"))


@query("txt_page_text", r"""select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) as text_hash from pages""")
def _(t):
    return t.pages.select("page_id", F.md5(S.strip_tags(F.col("html"))).alias("text_hash"))


@query("txt_content_hash", "select doc_id, sha256(text) as hash from documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("txt_cursor", """select event_id, event_id as seq from events""")
def _(t):
    cursor = F.base64(F.to_json(F.struct(F.col("event_id").alias("seq"), F.lit(1).alias("v"))).cast("binary"))
    return t.events.select("event_id", S.cursor_seq(cursor).alias("seq"))


@query("txt_json_fields", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("txt_backoff", "select event_id, least(30.0::double * pow(2.0, event_id % 9), 3600.0) as wait from events")
def _(t):
    return t.events.select("event_id", S.backoff(F.col("event_id") % 9 + 1).alias("wait"))


@query("txt_reference_time", """select fact_id, coalesce(case when relation = 'A' then invalid_at end, case when relation = 'N' then valid_at end, timestamp '1998-06-01') as at,
    case when relation = 'A' and invalid_at is not null then 'content' when relation = 'N' then 'updated' else 'now' end as basis from fact""")
def _(t):
    a, b = F.when(F.col("relation") == "A", F.col("invalid_at")), F.when(F.col("relation") == "N", F.col("valid_at"))
    now = F.expr("timestamp_ntz'1998-06-01 00:00:00'")
    return t.fact.select("fact_id", F.coalesce(a, b, now).alias("at"), F.when(a.isNotNull(), "content").when(b.isNotNull(), "updated").otherwise("now").alias("basis"))


@query("chunk_markdown_sections")
def _(t):
    return C.markdown_chunks(t.documents, "doc_id", "source", "text")


@query("chunk_pack_paragraphs", r"""with recursive l as (select doc_id, list_filter(list_transform(string_split_regex(array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)),
      lambda x: case when regexp_matches(x, '^#{1,6}\s+\S') then chr(10) || x || chr(10) when trim(x) = '' then '' else x end), chr(10)), '\n\n+'), lambda x: trim(x, chr(10))), lambda x: x <> '') as b from documents),
    r(doc_id, i, ordinal, size, length) as (select doc_id, 1, 0, length(b[1]), length(b[1]) from l where len(b) > 0 union all
      select r.doc_id, i + 1, ordinal + (size + length(b[i + 1]) > 1200)::int, case when size + length(b[i + 1]) > 1200 then length(b[i + 1]) else size + length(b[i + 1]) end,
        case when size + length(b[i + 1]) > 1200 then length(b[i + 1]) else r.length + 2 + length(b[i + 1]) end from r join l on l.doc_id = r.doc_id where i < len(b))
    select doc_id, ordinal, max(length)::int as length from r group by doc_id, ordinal""")
def _(t):
    return C.pack_blocks(t.documents, "doc_id", "text", 1200)


@query("src_5_toc_flatten", """select 'v' || vendor_id as id, vendor as title, null as parent, 0 as level, 0 as place from vendor where vendor_id in (select vendor_id from product)
    union all select 'p' || product_id, product, 'v' || vendor_id, 1, (row_number() over (partition by vendor_id order by product_id) - 1)::int from product""")
def _(t):
    """A table of contents of two levels made from the catalog, flattened again."""
    child = F.struct("product_id", F.concat(F.lit("p"), "product_id").alias("id"), F.col("product").alias("title"))
    leaf = t.product.groupBy("vendor_id").agg(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias("children"))
    toc = leaf.join(t.vendor, "vendor_id").select(F.to_json(F.struct(F.concat(F.lit("v"), "vendor_id").alias("id"), F.col("vendor").alias("title"), "children")).alias("toc"))
    return C.flatten_toc(toc, "toc")


_NAME = """case when len(w) < 10 then 'Nothing here' when doc_id % 6 = 0 then w[3] || ' ' || w[4] when doc_id % 6 = 1 then w[3] || 's ' || w[9] || 'ing' when doc_id % 6 = 2 then 'Vault of ' || w[2]
    when doc_id % 6 = 3 then w[4] || ' and ' || w[9] || ' nowhere' when doc_id % 6 = 4 then w[2] || ' kept elsewhere' else text[1:12] end"""
_FLAT = r"(' ' || trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[\r\n|,;]|[.:!?]+(\s|$)', ' ¶ ', 'g'), '[^a-z0-9¶]+', ' ', 'g')) || ' ')"
_BARE = "list_filter([{w}, " + ", ".join(f"case when ends_with({{w}}, '{e}') and length({{w}}) >= {len(e) + 3} then left({{w}}, length({{w}}) - {len(e)}) end" for e in GR.LOSES) + ", case when regexp_matches({w}, '..(ies|ied)$') then left({w}, length({w}) - 3) || 'y' end], lambda s: s is not null)"


@query("flt_13_grounding", rf"""with d as (select doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), n as (select doc_id, text, {_NAME} as name from d where text is not null),
    f as (select doc_id, name, {_FLAT.format(x='text')} as flat, {_FLAT.format(x='name')} as nf, lower(text) as low, lower(trim(name)) as ln from n),
    v as (select *, (trim(nf) <> '' and contains(flat, nf)) or regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(ln) || '($|[^a-z0-9])') as said, string_split(trim(flat), ' ') as there from f),
    own as (select doc_id, generate_subscripts(o, 1) as pos, unnest(o) as w from (select doc_id, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: length(x) >= 2 and not list_contains({GR.WEAK}, x)) as o from v)),
    form as (select doc_id, pos, w, unnest({_BARE.format(w='w')}) as s from own),
    hit as (select distinct f.doc_id, pos from form f join (select doc_id, unnest(list_distinct(there)) as t from v) x on x.doc_id = f.doc_id and case when length(w) = 2 then t in (w, w || 's')
      else regexp_full_match(t, s || '(s|es|d|ed|ing|[a-z]ed|[a-z]ing)?') or ends_with(s, 'y') and t in (left(s, length(s) - 1) || 'ies', left(s, length(s) - 1) || 'ied') end),
    share as (select doc_id, count(*) as n, count(h.pos) as k from own left join hit h using (doc_id, pos) group by doc_id)
    select doc_id, name, said or coalesce(3 * k >= 2 * n, false) as grounded from v left join share using (doc_id)""")
def _(t):
    """Names made from the words of a text, as they are, inflected, in part or not at all."""
    w = S.tokens(F.col("text"))
    at = lambda i: F.get("w", F.lit(i - 1))
    kind = F.col("doc_id") % 6
    name = (
        F.when(F.size("w") < 10, "Nothing here").when(kind == 0, F.concat(at(3), F.lit(" "), at(4))).when(kind == 1, F.concat(at(3), F.lit("s "), at(9), F.lit("ing"))).when(kind == 2, F.concat(F.lit("Vault of "), at(2)))
        .when(kind == 3, F.concat(at(4), F.lit(" and "), at(9), F.lit(" nowhere"))).when(kind == 4, F.concat(at(2), F.lit(" kept elsewhere"))).otherwise(F.substring("text", 1, 12))
    )
    d = t.documents.filter("text is not null").select("doc_id", "text", w.alias("w")).select("doc_id", "text", name.alias("name"))
    return GR.grounded(d, "doc_id", "name", "text")


@query("flt_14_grounded_names", rf"""select id, array_to_string(n, '|') as names from (with d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w, source, lang, {_FLAT.format(x='text')} as flat from documents where text is not null)
    select id, list_filter([w[2], w[6], case when contains(flat, ' vault of nowhere ') then 'Vault of Nowhere' end, case when contains(flat, ' src ') and source in ('src0', 'src1', 'src2') then source when contains(flat, ' src ') then 'SRC' end], lambda x: x is not null)
      || case when contains(flat, ' src ') and source in ('src0', 'src1', 'src2') then [] else [source] end as n from d where len(w) > 5)""")
def _(t):
    """Entities of a text by what stands in it; an alias of its product becomes the product, which is there in any case."""
    w = S.tokens(F.col("text"))
    names = RU.let(w, lambda x: F.array(F.get(x, F.lit(1)), F.get(x, F.lit(5)), F.lit("Vault of Nowhere"), F.lit("SRC")))
    rows = t.documents.filter(F.size(w) > 5).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("product"), F.col("lang").alias("vendor"), names.alias("names"), F.array(*map(F.lit, ("Feature", "Feature", "Product", "Product"))).alias("types"))
    return GR.admit_entities(rows, {}, {f"src{i}": ["SRC"] for i in range(3)}).select("id", F.array_join("names", "|").alias("names"))
