"""C4: interval algebra over line items as page ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources.tables import SECTIONS_SQL, as_text, read, sections
from .registry import query

S = f"with {SECTIONS_SQL}"


@query(f"{S} select book_id, count(distinct page) as pages from (select book_id, unnest(generate_series(start_page, end_page)) as page from sections where is_read) group by 1")
def coverage_union(spark, sf_dir):
    return iv.union_measure(sections(spark, sf_dir).filter("is_read"), ["book_id"], "start_page", "end_page")


@query(f"{S}, p as (select book_id, unnest(generate_series(start_page, end_page)) as page from sections), n as (select book_id, count(distinct page) as pages from p group by 1), q as (select book_id, count(*) as parts from (select distinct book_id, extract(year from updated_at) as y from sections) group by 1) select n.book_id, pages, parts from n join q on q.book_id = n.book_id")
def coverage_merged(spark, sf_dir):
    """Bitmaps kept by year, merged to one a book, as a rollup that grows by day would be."""
    s = sections(spark, sf_dir).withColumn("y", F.year("updated_at"))
    kept = iv.page_words(s, ["book_id", "y"], "start_page", "end_page")
    pages = iv.measure_words(iv.merge_words(kept, ["book_id"]), ["book_id"])
    return pages.join(kept.groupBy("book_id").agg(F.count_distinct("y").alias("parts")), "book_id").select("book_id", "pages", "parts")


@query(f"{S}, r as (select *, row_number() over () as i from sections) select distinct a.book_id from r a join r b on a.book_id = b.book_id and a.i < b.i and a.start_page <= b.end_page and b.start_page <= a.end_page")
def overlap_check(spark, sf_dir):
    return iv.overlapping_keys(sections(spark, sf_dir), "book_id", "start_page", "end_page")


NEW_SQL = "fresh as (select book_id, no as ord, case when no % 2 = 0 then start_page else start_page + 3 end as \"start\", end_page + 3 as \"end\" from sections)"


def _new(s):
    return s.select("book_id", F.col("no").alias("ord"), F.when(F.col("no") % 2 == 0, F.col("start_page")).otherwise(F.col("start_page") + 3).alias("start"), (F.col("end_page") + 3).alias("end"))


@query(f"""{S}, o as (select book_id, start_page // 20 as s, end_page // 20 as e, no, row_number() over (partition by book_id, start_page // 20, end_page // 20 order by no) as n from sections where no > 2),
f as (select book_id, start_page // 20 as s, end_page // 20 as e, no as ord, row_number() over (partition by book_id, start_page // 20, end_page // 20 order by no) as n from sections)
select f.book_id, f.s, f.e, f.ord, coalesce(o.no, 0) as claimed from f left join o on f.book_id = o.book_id and f.s = o.s and f.e = o.e and f.n = o.n""")
def exact_claim(spark, sf_dir):
    s = sections(spark, sf_dir)
    s_, e_ = F.floor(F.col("start_page") / 20).cast("int").alias("s"), F.floor(F.col("end_page") / 20).cast("int").alias("e")
    old = s.filter("no > 2").select("book_id", s_, e_, "no")
    new = s.select("book_id", s_, e_, F.col("no").alias("ord"))
    return iv.exact_claims(old, new, ["book_id", "s", "e"], "no", "ord").select("book_id", "s", "e", "ord", F.coalesce("no", F.lit(0)).alias("claimed"))


@query(f"""{S}, {NEW_SQL} select o.book_id, o.no, f.ord, greatest(o.start_page, f."start") as "from", least(o.end_page, f."end") as "to" from sections o join fresh f on o.book_id = f.book_id and o.start_page <= f."end" and f."start" <= o.end_page""")
def range_overlap(spark, sf_dir):
    s = sections(spark, sf_dir)
    return iv.overlaps(s, _new(s), "book_id", ("start_page", "end_page"), ("start", "end")).select("book_id", "no", "ord", "from", "to")


@query(f"""{S}, {NEW_SQL}, p as (select f.book_id, f.ord, unnest(generate_series(greatest(o.start_page, f."start"), least(o.end_page, f."end"))) as page from sections o join fresh f on o.book_id = f.book_id and o.start_page <= f."end" and f."start" <= o.end_page where o.is_read),
n as (select book_id, ord, count(distinct page) as n from p group by 1, 2),
l as (select f.book_id, f.ord, max(o.read_at) as t from sections o join fresh f on o.book_id = f.book_id and o.start_page <= f."end" and f."start" <= o.end_page where o.is_read group by 1, 2)
select f.book_id, f.ord, coalesce(n.n, 0) as read_pages, coalesce(n.n, 0) * 2 > f."end" - f."start" + 1 as is_read,
  case when coalesce(n.n, 0) * 2 > f."end" - f."start" + 1 then strftime(l.t, '%Y-%m-%d') else '-' end as read_at
from fresh f left join n on n.book_id = f.book_id and n.ord = f.ord left join l on l.book_id = f.book_id and l.ord = f.ord""")
def carry_over(spark, sf_dir):
    s = sections(spark, sf_dir)
    out = iv.carry_over(s, _new(s), "book_id")
    return out.select("book_id", "ord", "read_pages", "is_read", F.coalesce(F.date_format("read_at", "yyyy-MM-dd"), F.lit("-")).alias("read_at"))


def _covered(spark, sf_dir, missing=13):
    p = read(spark, sf_dir, "part").filter(F.col("p_partkey") % missing != 0)
    pages = p.select(F.col("p_partkey").cast("int").alias("page"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name")).alias("md"))
    out = iv.covered(sections(spark, sf_dir), pages, ["book_id", "no"], "md")
    return out.withColumn("text", F.coalesce("text", F.lit("-")))


PAGES_SQL = "pages_md as (select cast(p_partkey as int) as page, case when p_partkey % 7 = 0 then '' else p_name end as md from part where p_partkey % 13 <> 0)"


COVER_SQL = f"""{S}, {PAGES_SQL}, w as (select book_id, no, unnest(generate_series(start_page, end_page)) as page from sections)
select book_id, no, count(*) as n_pages, count(*) filter (where md is null) as n_missing, case when count(*) filter (where md is null) = 0 then coalesce(string_agg(md, chr(10) || chr(10) order by w.page) filter (where md <> ''), '') else '-' end as text from w left join pages_md p on p.page = w.page group by 1, 2"""


@query(COVER_SQL)
def page_cover(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(COVER_SQL.replace("% 13", "% 101"))
def page_cover_all(spark, sf_dir):
    """As ``page_cover``, of a book that lacks few of its pages."""
    return _covered(spark, sf_dir, 101)


LEAVES_SQL = "leaves as (select conv_id, turn as ord, turn // 3 as chapter, case when (conv_id + turn) % 5 <> 0 then cast(turn * 4 + conv_id % 3 + 1 as int) end as page from conversations)"


@query(f"""with {LEAVES_SQL}, a as (select *, coalesce(page, 1) as "start", lead(page) over o as np, lead(chapter) over o as nc from leaves window o as (partition by conv_id order by ord)),
b as (select *, nc is null or nc <> chapter as last from a),
c as (select *, max(case when last then coalesce(np - 1, 100) end) over (partition by conv_id, chapter) as bound, first_value("start") over (partition by conv_id, chapter order by ord) as chapter_start from b)
select conv_id, ord, chapter, "start", chapter_start, greatest(chapter_start, bound) as chapter_end,
  greatest("start", case when last then greatest(chapter_start, bound) else coalesce(np - 1, greatest(chapter_start, bound)) end) as "end" from c""")
def outline_ranges(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    page = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, (F.col("turn") * 4 + F.col("conv_id") % 3 + 1).cast("int"))
    leaves = c.select("conv_id", F.col("turn").alias("ord"), F.floor(F.col("turn") / 3).alias("chapter"), page.alias("page"))
    return iv.range_ends(leaves, "conv_id", F.lit(100)).select("conv_id", "ord", "chapter", "start", "chapter_start", "chapter_end", "end")


@query("""with b as (select p_partkey as id, cast(p_size * 13 as int) as pages from part), s as (select *, case when pages <= 20 then pages when pages <= 100 then 10 when pages <= 500 then 20 else 30 end as size from b where pages > 0)
select id, cast(page as int) as page, cast((page - 1) // size as int) as chapter, cast(page - (page - 1) // size * size as int) as place from (select *, unnest(generate_series(1, pages)) as page from s)""")
def batch_structure(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 13).cast("int").alias("pages"))
    return iv.batch_structure(p, "pages").select("id", "page", "chapter", "place")


#: line numbers repeat within an order; here each line has a place of its own
NUMBERED_SQL = SECTIONS_SQL.replace("sections as", "raw as", 1) + ", sections as (select * replace (row_number() over (partition by book_id order by no, start_page, end_page, updated_at, is_read) as no) from raw)"


@query(f"""with {NUMBERED_SQL}, {NEW_SQL},
o as (select book_id, start_page as s, end_page as e, no, read_at, row_number() over (partition by book_id, start_page, end_page order by no) as n from sections),
g as (select *, row_number() over (partition by book_id, "start", "end" order by ord) as n from fresh),
m as (select g.book_id, g.ord, g."start", g."end", o.no as claimed, o.read_at from g left join o on g.book_id = o.book_id and g."start" = o.s and g."end" = o.e and g.n = o.n),
p as (select f.book_id, f.ord, unnest(generate_series(greatest(o.start_page, f."start"), least(o.end_page, f."end"))) as page from sections o join fresh f on o.book_id = f.book_id and o.start_page <= f."end" and f."start" <= o.end_page where o.is_read),
c as (select book_id, ord, count(distinct page) as n from p group by 1, 2),
l as (select f.book_id, f.ord, max(o.read_at) as t from sections o join fresh f on o.book_id = f.book_id and o.start_page <= f."end" and f."start" <= o.end_page where o.is_read group by 1, 2),
x as (select m.*, coalesce(c.n, 0) * 2 > m."end" - m."start" + 1 as r, l.t from m left join c on c.book_id = m.book_id and c.ord = m.ord left join l on l.book_id = m.book_id and l.ord = m.ord)
select book_id, ord, "start" as start_page, "end" as end_page, r as is_read, case when r then strftime(coalesce(read_at, t, timestamp '2000-01-01'), '%Y-%m-%d') else '-' end as read_at, coalesce('text ' || claimed, '-') as text, '-' as deleted_at, true as is_new from x
union all select book_id, no, start_page, end_page, is_read, coalesce(strftime(read_at, '%Y-%m-%d'), '-'), 'text ' || no, '2000-01-01', false from sections""")
def structure_replace(spark, sf_dir):
    """A new structure for every book: old sections as tombstones, new ones with what they keep."""
    place = Window.partitionBy("book_id").orderBy("no", "start_page", "end_page", "updated_at", "is_read")
    # without the time of reading, which follows from what the numbers take: so all uses of the numbered rows share one shuffle
    s = sections(spark, sf_dir).drop("read_at").withColumn("no", F.row_number().over(place).cast("long"))
    s = s.withColumn("read_at", F.when(F.col("is_read"), F.col("updated_at")))
    none = F.lit(None).cast("timestamp_ntz")
    old = s.select("book_id", F.col("no").alias("ord"), "start_page", "end_page", "is_read", "read_at", F.concat(F.lit("text "), F.col("no").cast("string")).alias("text"), none.alias("deleted_at"))
    out = iv.replace_structure(old, _new(s), "book_id", F.expr("timestamp_ntz '2000-01-01 00:00:00'"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("-")).alias(c)
    return out.select("book_id", "ord", "start_page", "end_page", "is_read", day("read_at"), F.coalesce("text", F.lit("-")).alias("text"), day("deleted_at"), "is_new")
