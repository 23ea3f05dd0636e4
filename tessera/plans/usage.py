"""C1: usage analytics over the events table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import usage
from ..sources.tables import USAGE_SQL, as_text, read, usage_events
from .registry import query

NOW = datetime(2024, 1, 30)
WINDOW_SQL = f"with {USAGE_SQL}, w as (select * from usage where created_at >= timestamp '2024-01-30' - interval 30 days)"
SUMS_SQL = "count(*) as calls, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, cast(coalesce(sum(cost_micro_usd), 0) as bigint) as cost_micro_usd"


def _window(spark, sf_dir):
    return usage.window(usage_events(spark, sf_dir), NOW, 30)


@query(f"{WINDOW_SQL} select {SUMS_SQL} from w")
def usage_totals(spark, sf_dir):
    return usage.totals(_window(spark, sf_dir))


@query(f"{WINDOW_SQL} select {SUMS_SQL} from w where user_id = 42")
def usage_totals_user(spark, sf_dir):
    return usage.totals(usage.window(usage_events(spark, sf_dir), NOW, 30, user_id=42))


@query(f"{WINDOW_SQL} select provider, model, {SUMS_SQL} from w group by 1, 2 order by sum(input_tokens) + sum(output_tokens) desc, 1, 2")
def usage_by_model(spark, sf_dir):
    return usage.grouped(_window(spark, sf_dir), "provider", "model").orderBy((F.col("input_tokens") + F.col("output_tokens")).desc(), "provider", "model")


@query(f"{WINDOW_SQL} select feature, {SUMS_SQL} from w group by 1 order by calls desc, 1")
def usage_by_feature(spark, sf_dir):
    return usage.grouped(_window(spark, sf_dir), "feature").orderBy(F.desc("calls"), "feature")


@query(f"{WINDOW_SQL} select strftime(date_trunc('day', created_at), '%Y-%m-%d') as day, {SUMS_SQL} from w group by 1 order by 1")
def usage_daily(spark, sf_dir):
    return usage.daily(_window(spark, sf_dir)).orderBy("day")


@query(f"{WINDOW_SQL} select id, provider, model, feature, input_tokens, output_tokens, coalesce(cost_micro_usd, 0) as cost_micro_usd, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from w order by w.created_at desc, id desc limit 25")
def usage_recent(spark, sf_dir):
    e = usage.recent(_window(spark, sf_dir), 25)
    return e.select("id", "provider", "model", "feature", "input_tokens", "output_tokens", F.coalesce("cost_micro_usd", F.lit(0)).alias("cost_micro_usd"), as_text("created_at").alias("created_at"))


@query("""select (select count(*) from customer) as users, (select count(*) from orders) as books,
  (select count(*) from orders where o_orderstatus = 'P') as jobs,
  (select cast(coalesce(sum(cast(floor(o_totalprice * 100 + 0.5) as bigint)), 0) as bigint) from orders where o_orderstatus = 'O') as revenue_cents""")
def dashboard_stats(spark, sf_dir):
    """Four one-row aggregates side by side; the two over orders share one scan."""
    o = read(spark, sf_dir, "orders")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    both = o.agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("o_orderstatus") == "P").alias("jobs"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", cents)), F.lit(0)).cast("long").alias("revenue_cents"))
    return read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("users")).join(both)
