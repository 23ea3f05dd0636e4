"""Relational base: predicates, joins, counts, paging, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.tables import BOOKS_SQL, SECTIONS_SQL, as_text, books, read, sections
from .registry import query

B = f"with {BOOKS_SQL}"
DATE = "strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at"


def _show(df):
    return df.withColumn("updated_at", as_text("updated_at")).drop("deleted_at")


COLUMNS = "id, user_id, catalog_id, status, cents"


@query("select r_regionkey, r_name from region")
def scan_region(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", "r_name")


@query(f"{B} select {COLUMNS}, {DATE} from books where id = 4001 and deleted_at is null limit 1")
def find_by_id(spark, sf_dir):
    return _show(rel.find_by_id(books(spark, sf_dir), 4001))


@query("select c_custkey, c_name, c_acctbal from customer where c_name = 'Customer#000000007'")
def find_by_key(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(F.col("c_name") == "Customer#000000007").select("c_custkey", "c_name", "c_acctbal")


@query(f"{B} select {COLUMNS}, {DATE} from books where id in (1, 2, 3, 5, 8, 13, 21, 999999999)")
def multi_get(spark, sf_dir):
    return _show(rel.find_by_ids(books(spark, sf_dir), [1, 2, 3, 5, 8, 13, 21, 999999999]))


@query(f"{B} select {COLUMNS}, {DATE} from books where id in (select l_orderkey from lineitem where l_quantity > 49)")
def multi_get_join(spark, sf_dir):
    ids = read(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_orderkey")
    return _show(rel.find_by_ids(books(spark, sf_dir), ids))


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('O', 'P') and o_totalprice >= 100000 and o_orderpriority <> '5-LOW'")
def predicates(spark, sf_dir):
    """Optional predicates: those that are None vanish."""
    o = read(spark, sf_dir, "orders")
    out = rel.where(o, F.col("o_orderstatus").isin("O", "P"), F.col("o_totalprice") >= 100000, None, F.col("o_orderpriority") != "5-LOW")
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"{B} select exists(select 1 from books where catalog_id = 8 and user_id <> 1 and deleted_at is null) as held")
def exists_other(spark, sf_dir):
    return rel.exists_other(books(spark, sf_dir), 8, 1)


SECTION_RULE = "start_page between 1 and 100 and end_page <= 140 and start_page <= end_page"


@query(f"with {SECTIONS_SQL} select book_id, count(*) filter (where {SECTION_RULE}) as good, count(*) filter (where not ({SECTION_RULE})) as rejected from sections group by book_id having rejected > 0")
def row_validity(spark, sf_dir):
    s = sections(spark, sf_dir)
    good, bad = rel.split_valid(s, F.expr(SECTION_RULE), "book_id")
    n, m = rel.count_by(good, "book_id", "good"), rel.count_by(bad, "book_id", "rejected")
    return m.join(n, "book_id", "left").select("book_id", F.coalesce("good", F.lit(0)).alias("good"), "rejected")


@query("select event_id, case when event_type in ('click', 'view', 'purchase') then event_type end as event_type, case when value between 0 and 100 then value end as value from events")
def lenient_coercion(spark, sf_dir):
    """Values out of their range become null; the row stays."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("event_type"))
    return e.select("event_id", kind.alias("event_type"), F.when(F.col("value").between(0, 100), F.col("value")).alias("value"))


@query(f"with {BOOKS_SQL}, {SECTIONS_SQL} select s.book_id, s.no, s.start_page, s.end_page from sections s where exists (select 1 from books b where b.id = s.book_id and b.user_id = 7 and b.deleted_at is null)")
def visible_sections(spark, sf_dir):
    return rel.visible_to(sections(spark, sf_dir), books(spark, sf_dir), 7).select("book_id", "no", "start_page", "end_page")


CATALOG_SQL = "catalog as (select p_partkey as id, p_name as title, timestamp '2024-01-01' + to_hours(cast(p_partkey % 48 as int)) as created_at, timestamp '2024-01-01' + to_hours(cast(p_partkey * 5 % 48 as int)) as updated_at from part)"


def _catalog(spark, sf_dir):
    hour = lambda n: F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast({n} as int))")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), hour("p_partkey % 48").alias("created_at"), hour("p_partkey * 5 % 48").alias("updated_at"))


CUTOFF = "timestamp '2024-01-02'"


@query(f"with {BOOKS_SQL}, {CATALOG_SQL} select id, title from catalog c where not exists (select 1 from books b where b.catalog_id = c.id) and created_at < {CUTOFF} and updated_at < {CUTOFF} order by id limit 100")
def orphan_reclaim(spark, sf_dir):
    cutoff = F.expr("timestamp_ntz '2024-01-02 00:00:00'")
    return rel.reclaimable(_catalog(spark, sf_dir), books(spark, sf_dir), cutoff).select("id", "title")


@query(f"with {BOOKS_SQL}, {CATALOG_SQL} select count(*) as deferred from catalog c where not exists (select 1 from books b where b.catalog_id = c.id) and (created_at >= {CUTOFF} or updated_at >= {CUTOFF})")
def orphan_deferred(spark, sf_dir):
    return rel.deferred(_catalog(spark, sf_dir), books(spark, sf_dir), F.expr("timestamp_ntz '2024-01-02 00:00:00'"))


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderdate >= timestamp '1998-01-01')")
def orphan_customers(spark, sf_dir):
    new = read(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'")
    return rel.orphans(read(spark, sf_dir, "customer"), new, "c_custkey", "o_custkey").select("c_custkey")


@query(f"{B} select b.id, b.catalog_id, coalesce(p.p_size, 0) as pages from books b left join (select * from part where p_size > 25) p on p.p_partkey = b.catalog_id")
def catalog_lookup(spark, sf_dir):
    pages = read(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("catalog_id"), F.col("p_size").alias("pages"))
    return rel.lookup(books(spark, sf_dir), pages, "catalog_id", "pages", 0).select("id", "catalog_id", "pages")


@query("select o.o_orderkey, c.c_name, n.n_name from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where o.o_totalprice > 150000")
def chained_lookup(spark, sf_dir):
    """Job to record by hash, record to owner: two inner joins, the small sides broadcast by size."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.filter("o_totalprice > 150000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query(f"{B} select p_partkey, p_name from part where p_partkey in (select catalog_id from books where deleted_at is null)")
def catalog_fanout(spark, sf_dir):
    ids = rel.live(books(spark, sf_dir)).select("catalog_id").distinct()
    return rel.find_by_ids(read(spark, sf_dir, "part"), ids, "p_partkey").select("p_partkey", "p_name")


@query(f"{B} select catalog_id, count(*) as n from books group by 1")
def count_with_tombstones(spark, sf_dir):
    return rel.count_by(books(spark, sf_dir), "catalog_id")


@query(f"{B} select user_id, count(*) as n from books where deleted_at is null group by 1")
def count_live(spark, sf_dir):
    return rel.count_by(rel.live(books(spark, sf_dir)), "user_id")


@query(f"""with {BOOKS_SQL}, {SECTIONS_SQL}
select b.user_id, count(*) as books, cast(coalesce(sum(s.n), 0) as bigint) as sections, strftime(max(b.updated_at), '%Y-%m-%d %H:%M:%S') as last
from books b left join (select book_id, count(*) as n from sections group by 1) s on s.book_id = b.id where b.deleted_at is null group by 1""")
def sync_status(spark, sf_dir):
    n = rel.count_by(sections(spark, sf_dir), "book_id").withColumnRenamed("book_id", "id")
    b = rel.live(books(spark, sf_dir)).join(n, "id", "left")
    return b.groupBy("user_id").agg(F.count(F.lit(1)).alias("books"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sections"), F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 50")
def top_k(spark, sf_dir):
    return read(spark, sf_dir, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name")


@query(f"{B} select {COLUMNS}, {DATE} from books order by id limit 5000")
def capped_list(spark, sf_dir):
    return _show(rel.capped_list(books(spark, sf_dir)))


@query("select c_custkey, c_name, (select count(*) from customer) as total from customer order by c_name, c_custkey limit 20 offset 40")
def offset_page(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    total = c.agg(F.count(F.lit(1))).scalar()
    return rel.page(c, 3, 20, "c_name", "c_custkey").select("c_custkey", "c_name", total.alias("total"))


@query(f"{B}, p as (select * from books where id > 100 order by id limit 51), n as (select count(*) as n from p) select {COLUMNS}, {DATE}, case when n > 50 then (select max(id) from (select id from p order by id limit 50)) end as next_after from (select * from p order by id limit 50), n")
def keyset_page(spark, sf_dir):
    return _show(rel.keyset_page(books(spark, sf_dir), 100, 50))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def latest_per_key(spark, sf_dir):
    return rel.latest_per(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'P' order by o_orderdate, o_orderkey limit 1")
def fifo_head(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")


@query(f"{B} select id, 'live' as kind from books where deleted_at is null and updated_at >= timestamp '1997-01-01' union all select id, 'tombstone' from books where deleted_at >= timestamp '1997-01-01'")
def tombstone_union(spark, sf_dir):
    """Changed rows and tombstones, each id once; the live row wins."""
    b = books(spark, sf_dir)
    since = F.expr("timestamp_ntz '1997-01-01 00:00:00'")
    alive = rel.live(b).filter(F.col("updated_at") >= since).select("id", F.lit("live").alias("kind"))
    return rel.union_first([alive, b.filter(F.col("deleted_at") >= since).select("id", F.lit("tombstone").alias("kind"))])


@query("select l_orderkey as id from lineitem where l_quantity > 45 union select o_orderkey from orders where o_totalprice > 200000")
def id_union(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return a.union(read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey")).distinct()


@query("select user_id, array_to_string(list_sort(list_intersect(list(distinct event_type), ['click', 'view'])), ',') as known from events group by 1")
def known_intersection(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return e.select("user_id", F.array_join(F.sort_array(F.array_intersect("kinds", F.array(F.lit("click"), F.lit("view")))), ",").alias("known"))


@query("select p_brand, array_to_string(list_sort(list(distinct p_type)), ',') as types, min(p_size) as least, max(p_size) as most from part group by 1")
def distinct_and_extremes(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


@query("select c_custkey as id, c_name, c_nationkey from customer")
def allowed_fields(spark, sf_dir):
    """An allow list in its own order, with a name that is not there, after a deny list."""
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return rel.allow(rel.deny(c, ["c_acctbal", "c_address"]), ["id", "c_name", "c_acctbal", "nothing", "c_nationkey"])


@query("select event_type, count(*) as n from events group by 1")
def payload_caps(spark, sf_dir):
    """A payload whose kinds are all within their caps passes whole."""
    e = read(spark, sf_dir, "events")
    kept = rel.capped(e.select("event_type", "event_id"), {"click": 1 << 40, "view": 1 << 40, "error": 1 << 40}, "event_type")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("with c(event_type, cap) as (values ('click', 10), ('view', 1000000000), ('error', 20)) select event_type, count(*) as n, any_value(cap)::bigint as cap from events join c using (event_type) group by 1 having count(*) > any_value(cap)")
def payload_over(spark, sf_dir):
    """Kinds of a payload that is too large, with their caps."""
    return rel.over_caps(read(spark, sf_dir, "events"), {"click": 10, "view": 1_000_000_000, "error": 20}, "event_type")


@query(f"{B} select least(count(*), 5000) as n, count(*) >= 5000 as at_cap from books")
def cap_warning(spark, sf_dir):
    return rel.cap_warning(books(spark, sf_dir))
