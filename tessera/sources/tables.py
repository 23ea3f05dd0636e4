"""Tables of the test data and the engine's entities as views over them.

Timestamps load as TIMESTAMP_NTZ; the sessions run in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, provider, model, feature, input_tokens, output_tokens, cost_micro_usd, created_at."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (k % 10).cast("string")).alias("model"),
        F.col("event_type").alias("feature"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        F.when(k % 11 != 0, F.floor(F.col("value") * 7).cast("long")).alias("cost_micro_usd"),
        F.col("ts").alias("created_at"),
    )


USAGE_SQL = """
usage as (
  select event_id as id, user_id, 'p' || (k % 3) as provider, 'm' || (k % 10) as model, event_type as feature,
         cast(floor(value * 100 + 0.5) as bigint) as input_tokens, cast(floor(value * 10) as bigint) as output_tokens,
         case when k % 11 <> 0 then cast(floor(value * 7) as bigint) end as cost_micro_usd, ts as created_at
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))
"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, catalog_id, status, price, updated_at, deleted_at: orders; status F is a tombstone."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("o_custkey") * 7 % 200 + 1).alias("catalog_id"),
        F.col("o_orderstatus").alias("status"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"),
    )


BOOKS_SQL = """
books as (
  select o_orderkey as id, o_custkey as user_id, o_custkey * 7 % 200 + 1 as catalog_id, o_orderstatus as status,
         cast(floor(o_totalprice * 100 + 0.5) as bigint) as cents, o_orderdate as updated_at,
         case when o_orderstatus = 'F' then o_orderdate end as deleted_at
  from orders)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, no, start_page, end_page, is_read, read_at, updated_at: line items as page ranges."""
    li = read(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 100 + 1).cast("int")
    return li.select(
        F.col("l_orderkey").alias("book_id"),
        F.col("l_linenumber").alias("no"),
        start.alias("start_page"),
        (start + F.col("l_quantity").cast("int") - 1).alias("end_page"),
        (F.col("l_returnflag") == "R").alias("is_read"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("read_at"),
        F.col("l_shipdate").alias("updated_at"),
    )


SECTIONS_SQL = """
sections as (
  select l_orderkey as book_id, l_linenumber as no, cast(l_partkey % 100 + 1 as int) as start_page,
         cast(l_partkey % 100 + 1 as int) + cast(floor(l_quantity) as int) - 1 as end_page, l_returnflag = 'R' as is_read,
         case when l_returnflag = 'R' then l_shipdate end as read_at, l_shipdate as updated_at
  from lineitem)
"""


def as_text(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
