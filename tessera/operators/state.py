"""Rate limits, retries, leases and idempotency over batches of events."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(events: DataFrame, key: str, ts: str, order: str, most: int, window_ms: int) -> DataFrame:
    """key, order, accepted, retry_after: a sliding log of accepted calls.

    A rejected call is not logged, so that the log needs state. After a whole window
    without a call the log is empty, so a key's calls are split there and the parts are
    worked on apart. A part is read in order, row by row, holding at most ``most`` times:
    neither a busy key nor a long one is gathered anywhere.
    """
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    calls = events.select(F.col(key).alias("key"), at.alias("t"), F.col(order).cast("long").alias("o"), F.floor(at / window_ms).alias("slot"))
    # of the slots with a call, those after an empty one begin a part
    slots = calls.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n")).drop("n")
    runs = Window.partitionBy("key").orderBy("slot")
    begins = F.when(F.coalesce(F.col("slot") - F.lag("slot").over(runs) > 1, F.lit(True)), F.col("slot"))
    slots = slots.withColumn("begins", begins).withColumn("part", F.last("begins", ignorenulls=True).over(runs.rowsBetween(Window.unboundedPreceding, 0)))
    slots = slots.select(F.col("key").alias("k"), F.col("slot").alias("s"), "part")
    calls = calls.join(slots, F.col("key").eqNullSafe(F.col("k")) & (F.col("slot") == F.col("s"))).select("key", "part", "t", "o")
    ordered = calls.repartition("key", "part").sortWithinPartitions("key", "part", "t", "o")

    def run(batches):
        now, log = None, deque()
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            accepted, wait = [], []
            for k, p, t in zip(keys, parts, batch.column(2).to_pylist(), strict=True):
                if now != (k, p):
                    now = (k, p)
                    log.clear()
                while log and t - log[0] >= window_ms:
                    log.popleft()
                ok = len(log) < most
                accepted.append(ok)
                wait.append(0 if ok else max(1, -((t - log[0] - window_ms) // 1000)))
                if ok:
                    log.append(t)
            yield pa.record_batch([batch.column(0), batch.column(3), pa.array(accepted, pa.bool_()), pa.array(wait, pa.int64())], ["key", "o", "accepted", "retry_after"])

    kind = events.schema[key].dataType.simpleString()
    return ordered.mapInArrow(run, f"key {kind}, o long, accepted boolean, retry_after long").toDF(key, order, "accepted", "retry_after")


def locked_out(failures: DataFrame, key: str, ts: str, order: str, most: int, window_ms: int) -> DataFrame:
    """Over a log of recorded failures: is the key locked after each of them?"""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy("__t").rangeBetween(-(window_ms - 1), 0)
    return failures.withColumn("__t", at).withColumn("locked", F.count(F.lit(1)).over(recent) >= most).select(key, order, "locked")


def backoff_ms(attempts: Column) -> Column:
    """30 s, doubled a failure, at most 6 h; in double, as attempts have no bound."""
    return F.least(30_000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)), F.lit(21_600_000.0)).cast("long")


def stuck_jobs(jobs: DataFrame, now: Column, in_flight: DataFrame | None = None, stale_min: int = 10, retry_min: int = 60) -> DataFrame:
    """id, action: what a sweep does with active jobs that have not moved for a while.

    A pending job with a cost waits for its payment. Exactly ``retry_min`` old fails.
    """
    minutes = lambda n: F.expr(f"interval {n} minutes")
    old = jobs.filter(F.col("status").isin("pending", "processing") & (F.col("updated_at") < now - minutes(stale_min)))
    old = old.filter(~((F.col("status") == "pending") & F.col("cost_cents").isNotNull()))
    if in_flight is not None:
        old = old.join(in_flight.select("id"), "id", "left_anti")
    return old.select("id", F.when(F.col("created_at") > now - minutes(retry_min), "retry").otherwise("fail").alias("action"))


def webhook_action(events: DataFrame, now: Column) -> DataFrame:
    """Skip what is processed or has been in work for under a minute; process the rest."""
    young = (F.col("status") == "processing") & (F.col("created_at") > now - F.expr("interval 60 seconds"))
    skip = F.coalesce((F.col("status") == "processed") | young, F.lit(False))
    return events.withColumn("action", F.when(skip, "skip").otherwise("process"))


LEASE_MS = 150_000


def due_words(words: DataFrame, now: Column) -> DataFrame:
    """Live, not forwarded, and neither leased nor waiting for a retry."""
    owed = words.filter(F.col("deleted_at").isNull() & F.col("forwarded_at").isNull())
    return owed.filter(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))


def outbox_due(words: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The next batch, oldest first."""
    return due_words(words, now).orderBy("created_at", "id").limit(limit)


def _after_ms(now: Column, ms: Column | int) -> Column:
    ms = F.lit(ms) if isinstance(ms, int) else ms
    return now + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18, 6)"))


def claim(words: DataFrame, now: Column, limit: int = 1, lease_ms: int = LEASE_MS) -> DataFrame:
    """The table after a worker has claimed the oldest due rows, found by a subquery; ``claimed`` marks them.

    A claim is a lease: ``next_attempt_at`` moves on, so that no other worker takes the row
    before it ends. Attempts are counted when one fails, not here.
    """
    top = outbox_due(words, now, limit).select(F.col("id").alias("__top"))
    out = words.join(top, F.col("id") == F.col("__top"), "left")
    hit = F.col("__top").isNotNull()
    kind = words.schema["next_attempt_at"].dataType
    lease = F.when(hit, _after_ms(now, lease_ms).cast(kind)).otherwise(F.col("next_attempt_at"))
    return out.withColumn("next_attempt_at", lease).withColumn("claimed", hit).drop("__top")


def settle(words: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The table after attempts: ``outcomes`` has id and error (null: forwarded).

    A forwarded row is stamped and cleared; a failed one counts an attempt, keeps the
    error, and is due again after its backoff.
    """
    o = outcomes.select(F.col("id").alias("__id"), F.col("error").alias("__error"))
    out = words.join(o, F.col("id") == F.col("__id"), "left")
    hit, failed = F.col("__id").isNotNull(), F.col("__error").isNotNull()
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    columns = {
        "attempts": attempts.cast(words.schema["attempts"].dataType),
        "forwarded_at": F.when(hit & ~failed, now).otherwise(F.col("forwarded_at")),
        "next_attempt_at": F.when(failed, _after_ms(now, backoff_ms(attempts))).when(~hit, F.col("next_attempt_at")),
        "last_error": F.when(failed, F.substring("__error", 1, 500)).when(~hit, F.col("last_error")),
    }
    return out.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in words.columns))


# fixed values: stages and the share of the whole at which each begins and ends
STAGES = (("download", 0, 10), ("structure", 10, 30), ("text", 30, 80), ("finalize", 80, 100))


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Percent of the whole: linear within a stage."""
    out = F.lit(0)
    for name, a, b in STAGES:
        part = F.when(total > 0, done / total).otherwise(1.0)
        out = F.when(stage == name, F.floor(a + (b - a) * part)).otherwise(out)
    return out.cast("int")


def runs_on(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Cancellation checkpoints: for each (id, at), whether the job had not been cancelled by then.

    ``jobs``: id, cancelled_at (null: never). A checkpoint of an unknown job stops.
    """
    j = jobs.select(F.col("id").alias("__id"), "cancelled_at")
    go = F.col("__id").isNotNull() & (F.col("cancelled_at").isNull() | (F.col("cancelled_at") > F.col("at")))
    return checkpoints.join(j, F.col("id") == F.col("__id"), "left").withColumn("go", go).drop("__id", "cancelled_at")
