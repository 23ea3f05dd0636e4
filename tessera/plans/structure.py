"""C3: structure of positioned items, outlines and archives, on proxies of the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python_text as py
from ..functions import text as tx
from ..operators import structure as st
from ..sources.tables import read
from .documents import _sql_any
from .registry import query


def items(spark, sf_dir):
    """Conversations set as pages of positioned items: a turn a page, a word an item, ten words a line."""
    c = read(spark, sf_dir, "conversations")
    w = c.select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page"), F.posexplode(F.split("text", r"\s+")).alias("i", "str")).filter("str <> ''")
    row, col = F.floor(F.col("i") / 10), F.col("i") % 10
    height = F.when(row == 0, 14.0).otherwise(10.0)
    return w.select(
        "doc", "page", F.lit(600.0).alias("page_height"), "str", (col * 50.0).alias("x"), (F.lit(590.0) - row * 14.0 - (F.col("i") % 3)).alias("y"), height.alias("height"),
        (F.length("str") * 5.0).alias("width"), F.when(F.col("i") % 7 == 0, "Serif-Bold").otherwise("Serif").alias("font"),
    )


@query("""with w as (select cast(conv_id as varchar) as doc, cast(turn as int) as page, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: true)) as s, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 as i from conversations)
select doc, page, cast(i // 10 as int) as line, string_agg(s, ' ' order by i) as text from w where s <> '' group by 1, 2, 3""")
def item_lines(spark, sf_dir):
    return st.lines(items(spark, sf_dir)).select("doc", "page", "line", "text")


LAYOUT_SQL = f"""w as (select cast(conv_id as varchar) as doc, cast(turn as int) as page, unnest(regexp_split_to_array(text, '\\s+')) as s, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 as i from conversations),
it as (select doc, page, s, i, cast(i // 10 as int) as line, 10.0::double + (i // 10) * 14 + i % 3 as top, case when i < 10 then 14.0::double else 10.0::double end as height, case when i % 7 = 0 then 'Serif-Bold' else 'Serif' end as font from w where s <> ''),
ln as (select doc, page, line, min(top) as y, avg(height) as height, string_agg(s, ' ' order by i) as text, list(font) as fonts from it group by 1, 2, 3),
m as (select *, median(height) over (partition by doc, page) as med, y < 60 as in_head, y > 540 as in_foot from ln),
fo as (select it.doc, it.page, it.font, sum(length(it.s)) as n, min(it.i) as first from it join ln on it.doc = ln.doc and it.page = ln.page and it.line = ln.line where ln.y > 60 and ln.y < 540 group by 1, 2, 3),
mf as (select doc, page, arg_min(font, struct_pack(a := -n, b := first)) as main from fo group by 1, 2),
c as (select m.*, main is not null and not list_contains(fonts, main) and length(text) < 100 as strange, height > med * 1.15 as larger, height < med * 0.85 as small from m left join mf on m.doc = mf.doc and m.page = mf.page),
nt as (select *, max(case when small and y > 459 and regexp_matches(text, '{st.NOTE}') then 1 else 0 end) over (partition by doc, page) = 1 as has_notes from c),
z as (select *, case when in_head and ({_sql_any("text", st.HEAD)} or larger or strange) then 'header' when has_notes and in_foot and small then 'footnote'
  when in_foot and ({_sql_any("text", st.FOOT)} or {_sql_any("text", st.HEAD)} or (length(text) < 80 and height <= med) or strange) then 'footer' else 'body' end as kind from nt)"""

PARAGRAPHS_SQL = f"""{LAYOUT_SQL},
bo as (select *, kind = 'body' and larger as heading from z where kind = 'body'),
ga as (select *, y - lag(y) over (partition by doc, page order by line) as gap, lag(heading) over (partition by doc, page order by line) as before from bo),
mo as (select *, coalesce(median(gap) over (partition by doc, page), med * 1.5) * 1.5 as most from ga),
pn as (select *, sum(case when gap > most or heading <> before then 1 else 0 end) over (partition by doc, page order by line rows unbounded preceding) as par from mo),
p as (select doc, page, par, replace(replace(string_agg(text, chr(10) order by line), '-' || chr(10), ''), chr(10), ' ') as text, bool_and(heading) as heading from pn group by 1, 2, 3)"""


@query(f"with {LAYOUT_SQL} select doc, page, line, kind, kind = 'body' and larger as heading from z")
def page_layout(spark, sf_dir):
    return st.classify_lines(st.lines(items(spark, sf_dir))).select("doc", "page", "line", "kind", "heading")


@query(f"""with {PARAGRAPHS_SQL},
pg as (select doc, page, count(*) as n, arg_min(text, par) as ft, arg_min(heading, par) as fh, arg_max(text, par) as lt, arg_max(heading, par) as lh, max(par) as last from p group by 1, 2),
q as (select *, lag(n) over (partition by doc order by page) as bn, coalesce(not lag(lh) over (partition by doc order by page) and not fh and ft <> '' and lag(lt) over (partition by doc order by page) <> ''
  and not regexp_matches(lag(lt) over (partition by doc order by page), '[.!?:;"”]\\z') and regexp_matches(ft, '^[a-z]'), false) as may from pg),
r as (select *, may and coalesce(lag(may) over (partition by doc order by page), false) and bn = 1 as link from q),
s as (select *, sum(case when may and not link then 1 else 0 end) over (partition by doc order by page rows unbounded preceding) as run from r),
v as (select *, may and sum(case when link then 1 else 0 end) over (partition by doc, run order by page rows unbounded preceding) % 2 = 0 as goes from s),
x as (select *, case when lead(goes) over (partition by doc order by page) then lead(ft) over (partition by doc order by page) end as more from v)
select p.doc, p.page, cast(p.par - case when goes then 1 else 0 end as int) as paragraph, p.text || case when p.par = x.last and more is not null then ' ' || more else '' end as text, p.heading
from p join x on p.doc = x.doc and p.page = x.page where not (goes and p.par = 0)""")
def page_paragraphs(spark, sf_dir):
    return st.merge_pages(st.paragraphs(st.classify_lines(st.lines(items(spark, sf_dir)))))


@query("""with w as (select cast(conv_id as varchar) as doc, cast(turn as int) as page, unnest(regexp_split_to_array(text, '\\s+')) as s, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 as i from conversations)
select doc, page, cast(i // 10 as int) as line, cast(row_number() over (partition by doc, page, i // 10 order by i) - 1 as int) as word, s as text, i % 7 = 0 as bold, i % 7 <> 0 and length(s) % 5 = 0 as italic, (i % 10) * 50.0::double as x, length(s) * 5.0::double as width from w where s <> ''""")
def word_boxes(spark, sf_dir):
    """Words with style and place; items of five or ten letters are italic."""
    italic = (F.col("font") == "Serif") & (F.length("str") % 5 == 0)
    out = st.styled_words(items(spark, sf_dir).withColumn("font", F.when(italic, "Serif-Italic").otherwise(F.col("font"))))
    return out.select("doc", "page", "line", "word", "text", "bold", "italic", F.col("x").cast("double").alias("x"), F.col("width").cast("double").alias("width"))


@query("""select cast(conv_id as varchar) as doc, cast(turn as int) as page, count(*) as words, count(*) filter (where i % 7 = 0) as bold
from (select conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) as s, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 as i from conversations) where s <> '' group by 1, 2""")
def styled_words(spark, sf_dir):
    return st.styled_words(items(spark, sf_dir)).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("words"), F.count_if("bold").alias("bold"))


@query("""with c as (select cast(conv_id as varchar) as doc, turn, turn // 3 as top, text from conversations),
h as (select doc, top, max(case when turn % 3 = 0 then text end) as head, bool_or(turn % 3 = 0) as has_head, bool_or(turn % 3 <> 0) as has_kids from c group by 1, 2)
select c.doc, cast(row_number() over (partition by c.doc order by c.turn) as int) as ord, cast(dense_rank() over (partition by c.doc order by c.top) as int) as chapter, head as chapter_title,
  c.text || case when c.turn % 3 = 0 and has_kids then ' — Introduction' else '' end as title, cast(c.turn * 2 + 1 as int) as page from c join h on h.doc = c.doc and h.top = c.top where has_head""")
def outline_leaves(spark, sf_dir):
    """Outlines made of conversations: every third turn is a group of the two after it."""
    c = read(spark, sf_dir, "conversations")
    top = F.floor(F.col("turn") / 3).cast("int")
    path = F.when(F.col("turn") % 3 == 0, F.array(top)).otherwise(F.array(top, (F.col("turn") % 3).cast("int")))
    return st.outline_leaves(c.select(F.col("conv_id").cast("string").alias("doc"), path.alias("path"), F.col("text").alias("title"), (F.col("turn") * 2 + 1).cast("int").alias("page")))


@query("""with recursive n as (select conv_id as doc, turn as id, case when turn > 0 then (turn - 1) // 2 end as parent, cast(turn % 2 as int) as place, text as title from conversations),
t as (select doc, id, [place] as path, title from n where parent is null union all select n.doc, n.id, list_append(t.path, n.place), n.title from t join n on n.doc = t.doc and n.parent = t.id)
select doc, id, len(path) as depth, list_aggregate(list_transform(path, x -> cast(x as varchar)), 'string_agg', '/') as path, title from t""".replace("x -> cast", "lambda x: cast"))
def outline_paths(spark, sf_dir):
    """Turns as a tree, each one below the turn of half its number; a turn whose parent is missing is in no level."""
    c = read(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    nodes = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), parent.alias("parent"), (F.col("turn") % 2).cast("int").alias("place"), F.struct("turn", "text").alias("title"), F.lit(1).alias("page"))
    t = st.outline_paths(nodes)
    return t.select("doc", F.col("title.turn").alias("id"), F.size("path").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), F.col("title.text").alias("title"))


@query("select page_id, lower(regexp_replace(strip_accents(url), '[^A-Za-z0-9]', '', 'g')) as norm from pages")
def normalized_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", py.normalize("url").alias("norm"))


@query("""with n as (select p_partkey, lower(regexp_replace(strip_accents(p_name), '[^A-Za-z0-9]', '', 'g')) as norm from part),
e as (select p_partkey as ord, p_partkey - 14 as start_page, norm as needle from n order by p_partkey limit 5),
h as (select n.p_partkey as page, e.ord, e.start_page from n join e on contains(n.norm, 'chapter1' || e.needle) or (length(e.needle) >= 6 and contains(n.norm, e.needle)) where n.p_partkey between 1 and 150),
s as (select *, count(*) over (partition by page) as n from h),
f as (select ord, start_page, min(page) as page from s where n = 1 group by 1, 2 order by 3 limit 3),
v as (select page - start_page as "offset", count(*) as n, min(page) as first from f group by 1)
select * from (select cast("offset" as int) as "offset", 'titles' as source from v order by n desc, first limit 1) union all select 0, 'none' where not exists (select 1 from v)""")
def page_offset(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    entries = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("Chapter 1. "), "p_name").alias("title"), (F.col("p_partkey") - 14).cast("int").alias("start_page"))
    return st.page_offset(entries, p.select(F.col("p_partkey").cast("int").alias("page"), F.col("p_name").alias("text")))


@query("select c_custkey, concat_ws('. ', c_name, 'Translation: ' || c_mktsegment, case when c_nationkey > 12 then 'Context: ' || c_nationkey end) as text from customer")
def knowledge_text(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    context = F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", st.knowledge_text(F.col("c_name"), F.col("c_mktsegment"), context).alias("text"))


MARKED = "'One [^1]two' || chr(10) || '[^2]: note ' || c_name || chr(10) || '[^3]' || chr(10) || '  ${ }^{4}$ last ' || c_mktsegment"


@query("select c_custkey, 'One two' || chr(10) || chr(10) || '    note ' || c_name || chr(10) || chr(10) || chr(10) || '  ${ }^{4}$ last ' || c_mktsegment as clean from customer")
def marker_cleanup(spark, sf_dir):
    """Footnote references, a note, a bare reference and an indented formula."""
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.clean_markers(F.expr(MARKED.replace("chr(10)", r"'\n'"))).alias("clean"))


@query("""select c_custkey, 'attachment; filename="' || regexp_replace(n, '[^\\x20-\\x7e]', '_', 'g') || '"; filename*=UTF-8' || chr(39) || chr(39) || replace(replace(replace(replace(replace(url_encode(n), '%21', '!'), '(', '%28'), ')', '%29'), chr(39), '%27'), '*', '%2A') as header
from (select c_custkey, substr(c_name || ' — "Köln" a_b_c (' || c_mktsegment || '!) ~' || repeat('x', 100), 1, 100) as t from customer), lateral (select replace(substr(replace(c.t, '"', ''), 1, 100), '"', '') || '.pdf' as n from (select t) c)""")
def download_header(spark, sf_dir):
    """Names with marks, quotes, accents and more than 100 characters."""
    c = read(spark, sf_dir, "customer")
    title = F.concat("c_name", F.lit(' — "Köln" a/b:c ('), "c_mktsegment", F.lit("!) ~"), F.lit("x" * 100))
    return c.select("c_custkey", tx.content_disposition(F.substring(title, 1, 100), "pdf").alias("header"))


@query("select page_id, 'OEBPS/' || page_id || ' a.xhtml' as path from pages")
def resolved_hrefs(spark, sf_dir):
    """Percent-encoded relative references with a fragment, from a folder beside the target."""
    p = read(spark, sf_dir, "pages")
    href = F.concat(F.lit("../x/../"), F.col("page_id").cast("string"), F.lit("%20a.xhtml#top"))
    return p.select("page_id", tx.resolve_href(href, F.lit("OEBPS/nav")).alias("path"))


@query("select p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) || 'a1b2' as norm from part")
def normalized_names(spark, sf_dir):
    """Compatibility forms: a superscript, a fullwidth letter, a ligature's accent."""
    return read(spark, sf_dir, "part").select("p_partkey", py.normalize(F.concat("p_name", F.lit("Ａ¹ -b²"))).alias("norm"))


@query("select c_custkey, k, case k when 0 then trim(repeat('one ', 20)) || ' ' || c_name when 1 then trim(repeat('two ', 20)) else trim(repeat('six ', 20)) end as page from customer, (select unnest([0, 1, 2]) as k)")
def signature_pages(spark, sf_dir):
    """A text cut where the first words of its pages occur."""
    c = read(spark, sf_dir, "customer")
    text = F.concat(F.repeat(F.lit("one "), 20), F.col("c_name"), F.lit("\n"), F.repeat(F.lit("two "), 20), F.lit("\n"), F.repeat(F.lit("six "), 20))
    pages = py.split_by_signatures(text, F.array(*map(F.lit, ("one one", "two two", "six six"))))
    return c.select("c_custkey", F.posexplode(pages).alias("k", "page"))
