"""Scans, predicates, joins, counts and paging."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST_LIMIT = 5000
SMALL_LIST = 1000


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(deleted).isNull())


def find_by_id(df: DataFrame, id_: object, key: str = "id") -> DataFrame:
    """Point lookup among live rows."""
    return live(df).filter(F.col(key) == F.lit(id_)).limit(1)


def find_by_ids(df: DataFrame, ids: Sequence[object] | DataFrame, key: str = "id") -> DataFrame:
    """Multi-get: a short list as a pushed-down IN, a frame of ids as a left-semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    if not ids:
        return df.limit(0)
    if len(ids) > SMALL_LIST:
        return find_by_ids(df, df.sparkSession.createDataFrame([(x,) for x in ids], [key]), key)
    return df.filter(F.col(key).isin(list(ids)))


def every(predicates: Iterable[Column | None]) -> Column:
    """AND of the predicates that are given."""
    return reduce(lambda a, b: a & b, (p for p in predicates if p is not None), F.lit(True))


def where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    return df.filter(every(predicates))


def exists_other(df: DataFrame, catalog_id: object, user_id: object) -> DataFrame:
    """One row, one boolean: does another user hold a live row of the catalogue entry?"""
    found = live(df).filter((F.col("catalog_id") == F.lit(catalog_id)) & (F.col("user_id") != F.lit(user_id)))
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("held"))


def allow(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns that are there, in the list's order."""
    return df.select(*[c for c in columns if c in df.columns])


def deny(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def split_valid(df: DataFrame, rule: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows that pass and the ids of those that do not; an undecided rule rejects."""
    ok = F.coalesce(rule, F.lit(False))
    return df.filter(ok), df.filter(~ok).select(key)


def capped(df: DataFrame, caps: dict[str, int], kind: str = "kind") -> DataFrame:
    """The rows, or an error if a kind has more than its cap: the whole payload fails.

    Each row meets the count of its kind, one row a kind, by an equi join.
    """
    n = df.groupBy(kind).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(kind, "__kind")
    cap = F.try_element_at(F.create_map(*(F.lit(x) for item in caps.items() for x in item)), F.col("__kind"))
    n = n.filter(F.col("__kind").isNotNull()).withColumn("__over", F.col("__n") > cap)
    told = F.raise_error(F.concat(F.lit("payload too large: "), F.col("__kind"), F.lit(": "), F.col("__n").cast("string")))
    met = df.join(n, F.col(kind) == F.col("__kind"), "left")
    return met.filter(F.when(F.col("__over"), told).isNull()).drop("__kind", "__n", "__over")


def over_caps(df: DataFrame, caps: dict[str, int], kind: str = "kind") -> DataFrame:
    """kind, n, cap of the kinds that are over their caps: what a rejected payload is told."""
    n = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    cap = F.try_element_at(F.create_map(*(F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for item in caps.items() for x in item)), F.col(kind))
    return n.withColumn("cap", cap).filter(F.col("n") > F.col("cap"))


def visible_to(children: DataFrame, books: DataFrame, user_id: object, key: str = "book_id") -> DataFrame:
    """Rows whose book belongs to the user."""
    own = live(books).filter(F.col("user_id") == F.lit(user_id)).select(F.col("id").alias(key))
    return children.join(own, key, "left_semi")


def orphans(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents that no child points at; an anti join, never an outer join and a null test."""
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def reclaimable(catalog: DataFrame, books: DataFrame, cutoff: Column, limit: int = 100) -> DataFrame:
    """Orphans whose two timestamps are before the cutoff, the first ``limit`` by id."""
    return orphans(catalog, books, "id", "catalog_id").filter((F.col("created_at") < cutoff) & (F.col("updated_at") < cutoff)).orderBy("id").limit(limit)


def deferred(catalog: DataFrame, books: DataFrame, cutoff: Column) -> DataFrame:
    """How many orphans are still in their grace period."""
    young = (F.col("created_at") >= cutoff) | (F.col("updated_at") >= cutoff)
    return orphans(catalog, books, "id", "catalog_id").filter(young).agg(F.count(F.lit(1)).alias("deferred"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left lookup with a default for what is missing."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """Offset page of 1...10000, size 1...100; the total is a separate count."""
    number, size = max(1, min(10_000, number)), max(1, min(100, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def keyset_page(df: DataFrame, after: object | None, size: int, key: str = "id") -> DataFrame:
    """The page after a key and ``next_after``: its last key, or null if nothing follows.

    One row more than the page is read to learn whether there is more.
    """
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    ahead = rows.orderBy(key).limit(size + 1)
    n = F.row_number().over(Window.orderBy(key))
    more = F.count(F.lit(1)).over(Window.partitionBy()) > size
    last = F.max(F.when(F.col("__n") == size, F.col(key))).over(Window.partitionBy())
    return ahead.withColumn("__n", n).withColumn("next_after", F.when(more, last)).filter(F.col("__n") <= size).drop("__n")


def capped_list(df: DataFrame, limit: int = LIST_LIMIT, key: str = "id") -> DataFrame:
    """Every list is cut at ``limit`` rows, by key, so that the cut is the same each time."""
    return df.orderBy(key).limit(limit)


def cap_warning(df: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """One row: how many rows a list gives, and whether it reached its cap (the reader may miss some).

    Reads no more than ``limit`` rows.
    """
    n = df.limit(limit).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", (F.col("n") >= limit).alias("at_cap"))


def latest_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def union_first(frames: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Union where the first frame that has a key wins."""
    every_ = reduce(lambda a, b: a.unionByName(b), (f.withColumn("__rank", F.lit(i)) for i, f in enumerate(frames)))
    return latest_per(every_, [key], F.col("__rank").asc()).drop("__rank")
