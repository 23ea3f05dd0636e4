"""Usage analytics: totals, by model, by feature, by day, and the newest events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window(events: DataFrame, now: datetime, days: int, user_id: int | None = None) -> DataFrame:
    """The shared predicate: the last ``days`` days up to ``now`` and, if given, one user."""
    out = events.filter(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days"))
    return out if user_id is None else out.filter(F.col("user_id") == user_id)


def _sum(column: str):
    return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(column)


SUMS = ("input_tokens", "output_tokens", "cost_micro_usd")


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("calls"), *map(_sum, SUMS))


def grouped(events: DataFrame, *keys: str) -> DataFrame:
    """Calls and sums by the keys; an unknown cost does not count."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *map(_sum, SUMS))


def daily(events: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd").alias("day")
    return events.groupBy(day).agg(F.count(F.lit(1)).alias("calls"), *map(_sum, SUMS))


def recent(events: DataFrame, n: int = 25) -> DataFrame:
    """Top-k by time; ids break ties."""
    return events.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(n)
