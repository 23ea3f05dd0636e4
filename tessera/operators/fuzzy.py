"""Fuzzy titles, many against many: a trigram join with prefix, length and place filters.

Titles with the same set of trigrams are one class, so copies are compared once however
many there are. Two sets with similarity (shared over all trigrams) above t share at
least t of the trigrams of each. With every set in one order, rare trigrams first, such
a pair has a trigram in common within the first n - ceil(t n) + 1 of both: only these
are met, by an equi join on the trigram. A pair is compared where it meets first, if the
lengths and the places of the meeting leave room for enough in common. Nothing is
compared that shares no trigram, and no pair is shuffled.

Cases: a null or empty title, or one without a letter or digit, has no trigram and is
like none; a class is named by its least id; ids may be of any type that sorts; null ids
keep their titles but a class of theirs alone has a null name; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

ABOVE = 0.3


def _key(grams: Column) -> Column:
    return F.md5(F.array_join(F.array_sort(grams), "\0"))


def _code(gram: Column) -> Column:
    """A trigram as one number: its three code points of 21 bits."""
    point = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return F.shiftleft(point(1), 42) + F.shiftleft(point(2), 21) + point(3)


def _titles(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """title, id (the least), copies, grams, key: one row a distinct title, so that copies are cut into trigrams once.

    Titles without a trigram are still there: a filter on them would be pushed below the grouping, to every copy.
    """
    rows = df.groupBy(F.col(text).alias("title")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("grams", tx.trigrams(F.col("title"))).withColumn("key", _key(F.col("grams")))


def gram_sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """key, id (the least), copies, grams (as numbers): one row a class of titles."""
    rows = _titles(df, id_col, text)
    sets = rows.groupBy("key").agg(F.min("id").alias("id"), F.sum("copies").alias("copies"), F.first(F.transform("grams", _code)).alias("grams"))
    return sets.filter(F.size("grams") > 0)


def _in_order(sets: DataFrame, seen: DataFrame) -> DataFrame:
    """``sets`` with grams in order of how many classes of ``seen`` have them."""
    each = sets.select("key", F.explode("grams").alias("gram"))
    count = seen.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    order = each.join(count, "gram").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("order"))
    return sets.drop("grams").join(order, "key").withColumn("grams", F.col("order.gram")).drop("order")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, however small it is: what follows makes many rows of one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _prefixes(sets: DataFrame, above: float, tag: str) -> DataFrame:
    """A row for each gram of a set that a like set must share one of."""
    n = F.size("grams")
    upto = n - F.ceil(n * above).cast("int") + 1
    rows = sets.withColumn("n", n).withColumn("first", F.slice("grams", F.lit(1), F.least(n, upto)))
    rows = rows.select("*", F.posexplode("first").alias("at", "gram"))
    return rows.select(*(F.col(c).alias(f"{tag}_{c}" if c != "gram" else c) for c in rows.columns))


def similar_sets(left: DataFrame, right: DataFrame | None = None, above: float = ABOVE) -> DataFrame:
    """a_key, a_id, a_copies, b_..., rank: pairs of classes of similarity above ``above``.

    Without ``right``, each pair of different classes of ``left`` once, the smaller key first.
    """
    seen = left if right is None else left.select("grams").unionByName(right.select("grams"))
    t = above * (1 - 1e-6)  # ranks have single precision
    a = _prefixes(_in_order(left, seen), t, "a")
    b = _prefixes(_in_order(left if right is None else right, seen), t, "b")
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))  # places count from 0
    near = (F.col("a_n") >= F.col("b_n") * t) & (F.col("b_n") >= F.col("a_n") * t) & (room * (1 + t) >= (F.col("a_n") + F.col("b_n")) * t - 1e-9)
    if right is None:
        near &= F.col("a_key") < F.col("b_key")
    met = a.join(b, "gram").filter(near).filter(F.array_intersect("a_first", "b_first")[0] == F.col("gram"))
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    rank = (shared / (F.col("a_n") + F.col("b_n") - shared)).cast("float")
    met = met.select("a_key", "a_id", "a_copies", "b_key", "b_id", "b_copies", rank.alias("rank"))
    return met.filter(F.col("rank").cast("double") > above)


def similar_titles(df: DataFrame, id_col: str, text: str, above: float = ABOVE) -> DataFrame:
    """id, copies, other, other_copies, rank: pairs of different classes, each once, the smaller id first."""
    pairs = similar_sets(gram_sets(df, id_col, text), above=above)
    turn = F.coalesce(F.col("a_id") > F.col("b_id"), F.col("a_id").isNull())
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("a_id", "b_id").alias("id"), pick("a_copies", "b_copies").alias("copies"), pick("b_id", "a_id").alias("other"), pick("b_copies", "a_copies").alias("other_copies"), "rank")


def match_titles(wanted: DataFrame, catalog: DataFrame, id_col: str, text: str, above: float = ABOVE, digits: int | None = None) -> DataFrame:
    """wanted, found, rank: every wanted title with every one of the catalogue that is like it.

    With ``digits`` ranks are rounded, as doubles; that is done once a pair of titles. Only the
    last join makes a row of each pair of ids: by the size of its tables it would be one task,
    so wanted ids with the titles they are like are dealt out before it.
    """
    pairs = similar_sets(gram_sets(wanted, id_col, text), gram_sets(catalog, id_col, text), above)
    rank = F.col("rank") if digits is None else F.round(F.col("rank").cast("double"), digits)
    title = lambda df, side: _titles(df, id_col, text).select(F.col("key").alias(f"{side}_key"), F.col("title").alias(f"{side}_title"))
    ids = lambda df, side, name: df.select(F.col(text).alias(f"{side}_title"), F.col(id_col).alias(name))
    named = pairs.select("a_key", "b_key", rank.alias("rank")).join(title(wanted, "a"), "a_key").join(title(catalog, "b"), "b_key")
    rows = named.join(ids(wanted, "a", "wanted"), "a_title").select("b_title", "wanted", "rank")
    return _dealt(rows, "wanted", "b_title").join(ids(catalog, "b", "found"), "b_title").select("wanted", "found", "rank")
