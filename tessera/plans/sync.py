"""C2: sync algebra and DML post-states over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import sync
from ..sources.tables import BOOKS_SQL, SECTIONS_SQL, as_text, books, read, sections
from .registry import query

SINCE = "1997-06-01 00:00:00"


def ts(text: str):
    return F.expr(f"timestamp_ntz '{text}'")


def _shown(df, *columns):
    return df.select(*(as_text(c).alias(c) if c in ("updated_at", "deleted_at", "read_at") else F.col(c) for c in columns))


def _t(c: str, name: str | None = None) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '-') as {name or c}"


def _text(c):
    return F.coalesce(as_text(c), F.lit("-")).alias(c)


#: Client changes: every third order and some unknown ids, moved in time by the key.
CHANGES_SQL = """
changes as (
  select id + case when id % 33 = 0 then 100000000 else 0 end as id, case when id % 15 = 0 then user_id + 1 else user_id end as user_id,
         cents + id % 7 as cents, updated_at + to_days(cast(id % 5 - 2 as int)) as updated_at
  from books where id % 3 = 0)
"""


def _changes(b):
    moved = F.col("updated_at") + F.expr("make_dt_interval(cast(id % 5 - 2 as int))")
    return b.filter("id % 3 = 0").select(
        (F.col("id") + F.when(F.col("id") % 33 == 0, 100_000_000).otherwise(0)).alias("id"),
        F.when(F.col("id") % 15 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        (F.col("cents") + F.col("id") % 7).alias("cents"),
        moved.alias("updated_at"),
    )


KIND_SQL = "case when s.id is null then 'absent' when s.user_id <> c.user_id then 'foreign' when s.deleted_at is not null then 'tombstoned' when c.updated_at > s.updated_at then 'newer' else 'older' end"


@query(f"with {BOOKS_SQL} select id, {_t('updated_at')}, deleted_at is not null as dead from books where updated_at >= timestamp '{SINCE}'")
def change_feed(spark, sf_dir):
    return sync.change_feed(books(spark, sf_dir), ts(SINCE)).select("id", _text("updated_at"), F.col("deleted_at").isNotNull().alias("dead"))


@query(f"with {BOOKS_SQL}, p as (select * from books where updated_at >= timestamp '{SINCE}' and id > 5000 order by id limit 101) select id, case when (select count(*) from p) > 100 then (select max(id) from (select id from p order by id limit 100)) end as next_after from p order by id limit 100")
def change_feed_page(spark, sf_dir):
    return rel.keyset_page(sync.change_feed(books(spark, sf_dir), ts(SINCE)), 5000, 100).select("id", "next_after")


@query(f"with {BOOKS_SQL}, {CHANGES_SQL} select c.id, {KIND_SQL} as kind from changes c left join books s on s.id = c.id")
def sync_classify(spark, sf_dir):
    b = books(spark, sf_dir)
    return sync.classify(_changes(b), b).select("id", "kind")


@query(f"with {BOOKS_SQL}, {CHANGES_SQL}, k as (select c.*, {KIND_SQL} as kind from changes c left join books s on s.id = c.id), w as (select * from k where kind = 'newer') select s.id, coalesce(w.cents, s.cents) as cents, strftime(coalesce(w.updated_at, s.updated_at), '%Y-%m-%d %H:%M:%S') as updated_at from books s left join w on w.id = s.id")
def lww_apply(spark, sf_dir):
    b = books(spark, sf_dir)
    return _shown(sync.last_write_wins(b, _changes(b), ["cents"]), "id", "cents", "updated_at")


@query(f"with {BOOKS_SQL}, {CHANGES_SQL} select c.id from changes c join books s on s.id = c.id where s.user_id = c.user_id and s.deleted_at is not null")
def tombstone_echo(spark, sf_dir):
    b = books(spark, sf_dir)
    return sync.tombstone_echo(_changes(b), b)


PAIRS_SQL = """
pairs as (
  select l_orderkey as book_id, l_linenumber as no, l_shipdate + to_days(cast(l_partkey % 3 - 1 as int)) as c_updated_at, l_shipdate as s_updated_at,
         l_linestatus = 'O' as c_is_read, l_returnflag = 'R' as s_is_read,
         case when l_linestatus = 'O' and l_partkey % 2 = 0 then l_shipdate end as c_read_at, case when l_returnflag = 'R' then l_shipdate end as s_read_at,
         l_discount * 12 as c_scroll, l_tax * 10 as s_scroll
  from lineitem)
"""


def _pairs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("no"),
        (F.col("l_shipdate") + F.expr("make_dt_interval(cast(l_partkey % 3 - 1 as int))")).alias("c_updated_at"), F.col("l_shipdate").alias("s_updated_at"),
        (F.col("l_linestatus") == "O").alias("c_is_read"), (F.col("l_returnflag") == "R").alias("s_is_read"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_partkey") % 2 == 0), F.col("l_shipdate")).alias("c_read_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("s_read_at"),
        (F.col("l_discount") * 12).alias("c_scroll"), (F.col("l_tax") * 10).alias("s_scroll"),
    )


MERGE_SQL = f"""with {PAIRS_SQL}, m as (
select *, case when c_updated_at > s_updated_at then c_is_read else s_is_read or c_is_read end as is_read,
  case when c_updated_at > s_updated_at and c_is_read then coalesce(c_read_at, timestamp '2000-01-01') when c_updated_at > s_updated_at then null when s_is_read then s_read_at when c_is_read then coalesce(c_read_at, timestamp '2000-01-01') end as read_at,
  greatest(least(1.0::double, greatest(0.0::double, c_scroll)), least(1.0::double, greatest(0.0::double, s_scroll))) as scroll from pairs)
select book_id, no, is_read, {_t('read_at')}, scroll, not (is_read is not distinct from s_is_read and read_at is not distinct from s_read_at and cast(scroll as float) = cast(s_scroll as float)) as changed from m"""


@query(MERGE_SQL)
def section_merge(spark, sf_dir):
    m = sync.merge_progress(_pairs(spark, sf_dir), ts("2000-01-01 00:00:00"))
    return m.select("book_id", "no", "is_read", _text("read_at"), "scroll", "changed")


@query(f"with {SECTIONS_SQL}, {BOOKS_SQL} select s.book_id, s.no from sections s where s.book_id in (select id from books where deleted_at is null) and (s.no, s.book_id) in (select o_orderkey % 7 + 1, o_orderkey from orders)")
def valid_children(spark, sf_dir):
    chapters = books(spark, sf_dir).select((F.col("id") % 7 + 1).cast("int").alias("id"), F.col("id").alias("book_id"))
    s = sections(spark, sf_dir).withColumn("chapter_id", F.col("no"))
    return sync.valid_children(s, rel.live(books(spark, sf_dir)), chapters).select("book_id", "no")


@query(f"with {BOOKS_SQL} select id, case when id % 4 = 0 and id % 8 <> 0 then cents * 2 else cents end as cents, status from books")
def update_by_id(spark, sf_dir):
    b = books(spark, sf_dir)
    changes = b.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 != 0, F.col("cents") * 2).alias("cents"))
    return sync.update_by_id(b, changes, ["cents"]).select("id", "cents", "status")


@query(f"with {BOOKS_SQL} select id, {_t('case when user_id % 10 = 0 then coalesce(deleted_at, timestamp ' + chr(39) + '2000-01-01' + chr(39) + ') else deleted_at end', 'deleted_at')} from books")
def soft_delete_cascade(spark, sf_dir):
    b = books(spark, sf_dir)
    return sync.soft_delete(b, b.filter("user_id % 10 = 0").select("id"), ts("2000-01-01 00:00:00")).select("id", _text("deleted_at"))


@query(f"with {BOOKS_SQL} select id, {_t('case when id % 6 <> 0 then deleted_at end', 'deleted_at')} from books")
def restore(spark, sf_dir):
    b = books(spark, sf_dir)
    return sync.restore(b, b.filter("id % 6 = 0").select("id")).select("id", _text("deleted_at"))


@query(f"with {BOOKS_SQL}, {SECTIONS_SQL} select s.book_id, s.no from sections s join books b on b.id = s.book_id where b.deleted_at is null or b.deleted_at >= timestamp '1998-01-01'")
def retention_purge(spark, sf_dir):
    left = sync.purge(books(spark, sf_dir), ts("1998-01-01 00:00:00"))
    return sync.purge_children(sections(spark, sf_dir), left).select("book_id", "no")


@query("""with b as (select o_custkey as user_id, o_orderkey % 50 as exercise_id, max(o_orderkey) as book_id, count(*) as score, case when count(*) > 1 then 1 end as dead from orders where o_orderkey % 2 = 0 group by 1, 2),
c as (select o_custkey as user_id, o_orderkey % 50 as exercise_id, min(o_orderkey) as book_id, cast(-count(*) as bigint) as score from orders where o_orderkey % 3 = 0 group by 1, 2)
select coalesce(b.user_id, c.user_id) as user_id, coalesce(b.exercise_id, c.exercise_id) as exercise_id, coalesce(b.book_id, c.book_id) as book_id, coalesce(c.score, b.score) as score, coalesce(case when c.user_id is null then dead end, 0) as dead
from b full join c on b.user_id = c.user_id and b.exercise_id = c.exercise_id""")
def upsert_progress(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    keys = F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("exercise_id")
    before = o.filter("o_orderkey % 2 = 0").groupBy(*keys).agg(F.max("o_orderkey").alias("book_id"), F.count(F.lit(1)).alias("score"), F.when(F.count(F.lit(1)) > 1, 1).alias("deleted_at"))
    changes = o.filter("o_orderkey % 3 = 0").groupBy(*keys).agg(F.min("o_orderkey").alias("book_id"), (-F.count(F.lit(1))).alias("score"))
    after = sync.upsert(before, changes, ["user_id", "exercise_id"], ["score"])
    return after.withColumn("dead", F.coalesce("deleted_at", F.lit(0))).drop("deleted_at")


@query("select c_custkey, c_nationkey from customer union all select 1000000 + s_suppkey, s_nationkey from supplier")
def insert_do_nothing(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return sync.insert_missing(c, c.unionByName(s), ["c_custkey"])


@query(f"with {BOOKS_SQL} select p_partkey, p_size + (select count(*) from books where catalog_id = p_partkey) as users from part")
def increment_count(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("catalog_id"), F.col("p_size").cast("long").alias("users"))
    return sync.increment(p, books(spark, sf_dir), "catalog_id", "users").withColumnRenamed("catalog_id", "p_partkey")


@query(f"with {BOOKS_SQL} select id from books where id % 5 = 0 and id % 10 = 0")
def optimistic_conflicts(spark, sf_dir):
    b = books(spark, sf_dir)
    seen = F.when(F.col("id") % 10 == 0, F.col("updated_at") - F.expr("interval 1 day")).otherwise(F.col("updated_at"))
    return sync.optimistic(b, b.filter("id % 5 = 0").select("id", seen.alias("expected"), (F.col("cents") + 1).alias("cents")), "cents")[1]


@query(f"with {BOOKS_SQL} select id, case when id % 5 = 0 and id % 10 <> 0 then cents + 1 else cents end as cents from books")
def optimistic_apply(spark, sf_dir):
    b = books(spark, sf_dir)
    seen = F.when(F.col("id") % 10 == 0, F.col("updated_at") - F.expr("interval 1 day")).otherwise(F.col("updated_at"))
    return sync.optimistic(b, b.filter("id % 5 = 0").select("id", seen.alias("expected"), (F.col("cents") + 1).alias("cents")), "cents")[0].select("id", "cents")


JOB_SQL = "j as (select user_id as job_id, ts as t, event_id as seq, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'processing' end as status from events)"


@query(f"with {JOB_SQL} select job_id, coalesce(arg_min(status, struct_pack(a := t, b := seq)) filter (where status <> 'processing'), arg_max(status, struct_pack(a := t, b := seq))) as status from j group by 1")
def first_terminal(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return sync.first_terminal(e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), status.alias("status")))


@query("select id, hash from (select o_orderkey as id, o_custkey as hash, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders where o_orderstatus = 'P') where n > 1")
def active_job_violations(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("hash"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    return sync.duplicates_among(o, "hash", F.col("o_orderstatus") == "P")
