"""Two-way sync: change feeds, classification, merging, and DML as post-states.

There are no mutable tables; each mutation is a function from the before-image and
the changes to the state after. Writers apply one such frame a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAG = "interval 1 second"


def change_feed(df: DataFrame, since: Column | None) -> DataFrame:
    """Rows changed at or after the watermark, tombstones too."""
    return df if since is None else df.filter(F.col("updated_at") >= since)


def watermark(now: Column) -> Column:
    """To be taken before the reads: overlapping a second, so that no write is missed."""
    return now - F.expr(LAG)


def classify(changes: DataFrame, server: DataFrame, user: str = "user_id") -> DataFrame:
    """One join a batch of client changes: absent, foreign, tombstoned, newer or older.

    Equal times count as older: only a strictly newer client wins.
    """
    s = server.select(F.col("id").alias("__id"), F.col(user).alias("__user"), F.col("updated_at").alias("__updated"), F.col("deleted_at").alias("__deleted"))
    kind = (
        F.when(F.col("__id").isNull(), "absent")
        .when(F.col("__user") != F.col(user), "foreign")
        .when(F.col("__deleted").isNotNull(), "tombstoned")
        .when(F.col("updated_at") > F.col("__updated"), "newer")
        .otherwise("older")
    )
    return changes.join(s, F.col("id") == F.col("__id"), "left").withColumn("kind", kind).drop("__id", "__user", "__updated", "__deleted")


def last_write_wins(server: DataFrame, changes: DataFrame, columns: Sequence[str], user: str = "user_id") -> DataFrame:
    """Server rows after the changes; tombstones stay, absent rows are not created."""
    c = classify(changes, server, user).filter("kind = 'newer'").select(F.col("id"), F.col("updated_at").alias("__at"), *(F.col(x).alias(f"__{x}") for x in columns))
    hit = F.col("__at").isNotNull()
    out = server.join(c, "id", "left")
    put = {x: F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)) for x in columns} | {"updated_at": F.coalesce("__at", "updated_at")}
    return out.select(*(put[x].alias(x) if x in put else F.col(x) for x in server.columns))


def unit(x: Column) -> Column:
    """Clamped to [0, 1]; NaN and infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def merge_progress(pairs: DataFrame, now: Column) -> DataFrame:
    """Field-level merge of client (c_) and server (s_) columns.

    Needs c_/s_ updated_at, is_read, read_at, scroll. A newer client decides is_read,
    and a read without a time is stamped; otherwise a read on either side stays, with
    the time of the side that has it. The greater scroll wins. ``changed`` is false if
    the server row is already that, with scroll compared at single precision.
    """
    newer = F.col("c_updated_at") > F.col("s_updated_at")
    is_read = F.when(newer, F.col("c_is_read")).otherwise(F.col("s_is_read") | F.col("c_is_read"))
    stamp = F.coalesce("c_read_at", now)
    read_at = (
        F.when(newer & F.col("c_is_read"), stamp)
        .when(newer, F.lit(None))
        .when(F.col("s_is_read"), F.col("s_read_at"))
        .when(F.col("c_is_read"), stamp)
    )
    scroll = F.greatest(unit(F.col("c_scroll")), unit(F.col("s_scroll")))
    out = pairs.withColumn("is_read", is_read).withColumn("read_at", read_at).withColumn("scroll", scroll)
    same = F.col("is_read").eqNullSafe(F.col("s_is_read")) & F.col("read_at").eqNullSafe(F.col("s_read_at")) & (F.col("scroll").cast("float") == F.col("s_scroll").cast("float"))
    return out.withColumn("changed", ~same)


def tombstone_echo(changes: DataFrame, server: DataFrame, user: str = "user_id") -> DataFrame:
    """Ids whose tombstone a stale client has to be told again."""
    return classify(changes, server, user).filter("kind = 'tombstoned'").select("id")


def valid_children(children: DataFrame, parents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Children of known books whose chapter is of the same book."""
    known = children.join(parents.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    return known.join(chapters.select(F.col("id").alias("chapter_id"), "book_id"), ["chapter_id", "book_id"], "left_semi")


def update_by_id(df: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """A null in the changes leaves the column as it is."""
    c = changes.select(key, *(F.col(x).alias(f"__{x}") for x in columns))
    return df.join(c, key, "left").select(*(F.coalesce(f"__{x}", x).alias(x) if x in columns else F.col(x) for x in df.columns))


def soft_delete(df: DataFrame, ids: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Stamp live rows; those deleted before keep their time."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left").withColumn("deleted_at", F.when(F.col("__hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).select(*df.columns)


def restore(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left").withColumn("deleted_at", F.when(F.col("__hit").isNull(), F.col("deleted_at"))).select(*df.columns)


def purge(df: DataFrame, cutoff: Column) -> DataFrame:
    """Without the rows deleted before the cutoff."""
    return df.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") >= cutoff))


def purge_children(children: DataFrame, parents_left: DataFrame, key: str = "book_id") -> DataFrame:
    """Cascade: rows whose parent is gone go."""
    return children.join(parents_left.select(F.col("id").alias(key)), key, "left_semi")


def upsert(before: DataFrame, changes: DataFrame, keys: Sequence[str], set_columns: Sequence[str]) -> DataFrame:
    """Insert or update: listed columns from the change, tombstones lifted, others kept."""
    c = changes.select(*keys, *(F.col(x).alias(f"__{x}") for x in changes.columns if x not in keys), F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    out = before.withColumn("__old", F.lit(True)).join(c, list(keys), "full")

    def after(x: str) -> Column:
        if x in keys:
            return F.col(x)
        if x == "deleted_at":
            return F.when(~hit, F.col(x)).alias(x)
        new = F.col(f"__{x}") if x in changes.columns else F.lit(None)
        return F.when(hit & (F.lit(x in set_columns) | F.col("__old").isNull()), new).otherwise(F.col(x)).alias(x)

    return out.select(*map(after, before.columns))


def insert_missing(before: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or do nothing."""
    return before.unionByName(changes.join(before.select(*keys), list(keys), "left_anti"))


def increment(df: DataFrame, adds: DataFrame, key: str, column: str) -> DataFrame:
    n = adds.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, key, "left").withColumn(column, F.col(column) + F.coalesce("__n", F.lit(0))).select(*df.columns)


def optimistic(df: DataFrame, changes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(state after, conflicts): a change applies only to the version that it saw (``expected``)."""
    c = changes.select("id", F.col("expected"), F.col(column).alias("__new"))
    both = df.join(c, "id", "left")
    ok = F.col("expected").eqNullSafe(F.col("updated_at")) & F.col("expected").isNotNull()
    after = both.withColumn(column, F.when(ok, F.col("__new")).otherwise(F.col(column))).select(*df.columns)
    return after, both.filter(F.col("expected").isNotNull() & ~ok).select("id")


def first_terminal(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Compare-and-set transitions: the first terminal event of a job wins."""
    done = F.when(F.col("status").isin("completed", "failed", "cancelled"), F.struct("at", "seq", "status"))
    last = F.max(F.struct("at", "seq", "status"))
    return events.groupBy(key).agg(F.coalesce(F.min(done), last).alias("x")).select(key, F.col("x.status").alias("status"))


def duplicates_among(df: DataFrame, key: str, active: Column) -> DataFrame:
    """Violations of uniqueness among active rows: all but the first of a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("created_at", "id"))
    return df.filter(active).withColumn("__n", n).filter("__n > 1").select("id", key)
