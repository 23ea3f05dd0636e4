"""C6: queue, retry, outbox and rate limits over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from ..sources.tables import read
from .registry import query
from .sync import ts

DAY = 86_400_000


@query(f"""with recursive e as (select user_id, event_id, epoch_us(ts) // 1000 as t, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as n from events),
r as (select user_id, event_id, n, t, [t] as log, true as accepted, cast(0 as bigint) as retry_after from e where n = 1
  union all
  select e.user_id, e.event_id, e.n, e.t, case when len(k.kept) < 2 then list_append(k.kept, e.t) else k.kept end, len(k.kept) < 2,
    case when len(k.kept) < 2 then 0 else greatest(1, cast(ceil(({DAY} - (e.t - list_min(k.kept))) / 1000) as bigint)) end
  from r join e on e.user_id = r.user_id and e.n = r.n + 1, lateral (select list_filter(r.log, lambda x: e.t - x < {DAY}) as kept) k)
select user_id, event_id, accepted, retry_after from r""")
def rate_limit(spark, sf_dir):
    return state.rate_limit(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, DAY)


@query(f"with f as (select user_id, event_id, epoch_us(ts) // 1000 as t from events where event_type = 'error') select user_id, event_id, count(*) over (partition by user_id order by t range between {DAY - 1} preceding and current row) >= 2 as locked from f")
def failure_lockout(spark, sf_dir):
    return state.locked_out(read(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", "ts", "event_id", 2, DAY)


@query("select distinct cast(l_quantity as int) as attempts, cast(least(30000 * pow(2, greatest(0, cast(l_quantity as int) - 1)), 21600000) as bigint) as wait_ms from lineitem")
def backoff(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("attempts")).distinct()
    return n.select("attempts", state.backoff_ms(F.col("attempts")).alias("wait_ms"))


JOBS_SQL = "jobs as (select event_id as id, case event_type when 'click' then 'pending' when 'view' then 'processing' else 'completed' end as status, case when event_id % 3 = 0 then cast(value as bigint) end as cost_cents, ts - interval 30 minutes * (event_id % 5) as created_at, ts as updated_at from events)"
NOW = "timestamp '2024-01-15 12:00:00'"


def _jobs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "processing").otherwise("completed")
    made = F.col("ts") - F.expr("make_dt_interval(0, 0, cast(30 * (event_id % 5) as int))")
    return e.select(F.col("event_id").alias("id"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("long")).alias("cost_cents"), made.alias("created_at"), F.col("ts").alias("updated_at"))


@query(f"with {JOBS_SQL} select id, case when created_at > {NOW} - interval 60 minutes then 'retry' else 'fail' end as action from jobs where status in ('pending', 'processing') and updated_at < {NOW} - interval 10 minutes and not (status = 'pending' and cost_cents is not null) and id % 7 <> 0")
def stuck_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return state.stuck_jobs(jobs, ts("2024-01-15 12:00:00"), jobs.filter("id % 7 = 0"))


@query(f"with {JOBS_SQL} select id, case when status = 'completed' or (status = 'processing' and updated_at > {NOW} - interval 60 seconds) then 'skip' else 'process' end as action from jobs")
def webhook_action(spark, sf_dir):
    e = _jobs(spark, sf_dir).select("id", F.when(F.col("status") == "completed", "processed").otherwise(F.col("status")).alias("status"), F.col("updated_at").alias("created_at"))
    return state.webhook_action(e, ts("2024-01-15 12:00:00")).select("id", "action")


@query(f"with {JOBS_SQL} select id from jobs where status <> 'completed' and cost_cents is null and (id % 4 = 0 or updated_at <= {NOW}) order by created_at, id limit 20")
def outbox_due(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    words = j.select("id", "created_at", F.when(F.col("status") == "completed", F.col("updated_at")).alias("deleted_at"), F.when(F.col("cost_cents").isNotNull(), F.col("updated_at")).alias("forwarded_at"), F.when(F.col("id") % 4 != 0, F.col("updated_at")).alias("next_attempt_at"))
    return state.outbox_due(words, ts("2024-01-15 12:00:00")).select("id")


@query("select o_orderkey, cast(case o_orderstatus when 'O' then floor(10 + 20 * (o_orderkey % 11) / 10.0::double) when 'P' then floor(30 + 50 * ((o_orderkey % 11) / 10.0::double)) else floor(80 + 20 * ((o_orderkey % 11) / 10.0::double)) end as int) as percent from orders where o_orderstatus <> 'O'")
def progress(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'")
    stage = F.when(F.col("o_orderstatus") == "P", "text").otherwise("finalize")
    return o.select("o_orderkey", state.progress(stage, F.col("o_orderkey") % 11, F.lit(10.0)).alias("percent"))


LEASED = "timestamp '2024-01-15 12:02:30'"
WORDS_SQL = f"words as (select id, created_at, case when status = 'completed' then updated_at end as deleted_at, case when cost_cents is not null then updated_at end as forwarded_at, case when id % 4 <> 0 then updated_at end as next_attempt_at, cast(id % 3 as int) as attempts from jobs)"
SHOW = "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S'), '-') as {0}"


def _words(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return j.select(
        "id", "created_at", F.when(F.col("status") == "completed", F.col("updated_at")).alias("deleted_at"), F.when(F.col("cost_cents").isNotNull(), F.col("updated_at")).alias("forwarded_at"),
        F.when(F.col("id") % 4 != 0, F.col("updated_at")).alias("next_attempt_at"), (F.col("id") % 3).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"),
    )


def _time(c):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias(c)


@query(f"""with {JOBS_SQL}, {WORDS_SQL}, top as (select id from words where deleted_at is null and forwarded_at is null and (next_attempt_at is null or next_attempt_at <= {NOW}) order by created_at, id limit 1)
select id, strftime(case when id = (select id from top) then {LEASED} else coalesce(next_attempt_at, timestamp '2000-01-01') end, '%Y-%m-%d %H:%M:%S') as next_attempt_at, id = (select id from top) as claimed from words""")
def claim_next(spark, sf_dir):
    """An update of the one row that a subquery finds: the oldest due one is leased."""
    out = state.claim(_words(spark, sf_dir), ts("2024-01-15 12:00:00"))
    at = F.coalesce("next_attempt_at", ts("2000-01-01 00:00:00"))
    return out.select("id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("next_attempt_at"), "claimed")


@query(f"""with {JOBS_SQL}, {WORDS_SQL}, top as (select id from words where deleted_at is null and forwarded_at is null and (next_attempt_at is null or next_attempt_at <= {NOW}) order by created_at, id limit 40),
n as (select id, row_number() over (order by id) as k from top), o as (select id, k % 2 = 0 as failed from n),
x as (select w.*, o.id is not null as hit, coalesce(failed, false) as failed from words w left join o on o.id = w.id)
select id, cast(attempts + case when failed then 1 else 0 end as int) as attempts, {SHOW.format("forwarded_at")}, {SHOW.format("next_attempt_at")}, coalesce(last_error, '-') as last_error from (
  select id, attempts, failed, case when hit and not failed then {NOW} else forwarded_at end as forwarded_at,
    case when failed then {NOW} + to_milliseconds(cast(30000 * pow(2, attempts) as bigint)) when not hit then next_attempt_at end as next_attempt_at, case when failed then 'no answer' end as last_error from x)""")
def settle_claims(spark, sf_dir):
    """Two workers claim 20 rows each, one after the other; every second attempt fails."""
    from pyspark.sql import Window

    words, now = _words(spark, sf_dir), ts("2024-01-15 12:00:00")
    first = state.claim(words, now, 20)
    second = state.claim(first.drop("claimed"), now, 20)
    both = first.filter("claimed").select("id").unionByName(second.filter("claimed").select("id"))
    k = F.row_number().over(Window.orderBy("id"))
    outcomes = both.withColumn("error", F.when(k % 2 == 0, "no answer"))
    out = state.settle(words, outcomes, now)
    return out.select("id", "attempts", _time("forwarded_at"), _time("next_attempt_at"), F.coalesce("last_error", F.lit("-")).alias("last_error"))


@query("select o_orderkey as id, o_orderstatus <> 'F' or o_orderkey % 2 = 0 as go from orders")
def cancellation_checkpoints(spark, sf_dir):
    """Jobs of status F were cancelled on their date; odd ones come to a checkpoint after it."""
    o = read(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("cancelled_at"))
    moved = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") - F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    return state.runs_on(jobs, o.select(F.col("o_orderkey").alias("id"), moved.alias("at"))).select("id", "go")
