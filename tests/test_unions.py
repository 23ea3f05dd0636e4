"""Unions of ranges as bitmaps that merge, against sets and against one sorted window a key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import intervals as iv

LENGTHS = (1, 1, 2, 5, 63, 64, 65, 300, 4095, 4096, 4097, 9000, 300_000)


def by_window(df, keys, start, end):
    """One window a key: sorted by start, what is beyond the ends so far."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before + 1, F.col(start))) + 1)
    return df.withColumn("new", new).groupBy(*keys).agg(F.sum("new").cast("long").alias("pages"))


@pytest.fixture(scope="module")
def ranges():
    rng = random.Random(1)
    rows = []
    for k in range(50):
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(-200, 200) if k % 3 else rng.randint(-10_000, 60_000)
            end = rng.choice([a + rng.choice(LENGTHS) - 1] * 9 + [None, a - 3])
            rows.append((k if k else None, a if rng.random() < 0.95 else None, end))
    return rows


def pages_of(rows):
    out = {}
    for k, a, b in rows:
        out.setdefault(k, set()).update(range(a, b + 1) if a is not None and b is not None else ())
    return out


def test_union_measure(spark, ranges):
    df = spark.createDataFrame(ranges, "book long, a int, b int")
    got = {r["book"]: r["pages"] for r in iv.union_measure(df, ["book"], "a", "b").collect()}
    assert got == {k: len(v) for k, v in pages_of(ranges).items()}


def test_overlapping_keys(spark, ranges):
    df = spark.createDataFrame(ranges, "book long, a int, b int")
    got = sorted(str(r["book"]) for r in iv.overlapping_keys(df, "book", "a", "b").collect())
    total = {}
    for k, a, b in ranges:
        if a is not None and b is not None and a <= b:
            total[k] = total.get(k, 0) + b - a + 1
    assert got == sorted(str(k) for k, n in total.items() if n > len(pages_of(ranges)[k]))


def test_merged_parts_are_the_whole(spark, ranges):
    """Bitmaps of parts of the ranges, made apart, merge to those of all."""
    parts = [spark.createDataFrame(ranges[k::3], "book long, a int, b int") for k in range(3)]
    words = [iv.page_words(p, ["book"], "a", "b") for p in parts]
    merged = iv.merge_words(words[0].unionByName(words[1]).unionByName(words[2]), ["book"])
    whole = iv.page_words(spark.createDataFrame(ranges, "book long, a int, b int"), ["book"], "a", "b")
    rows = lambda df: sorted(map(str, df.select("book", "word", "bits").collect()))
    assert rows(merged) == rows(whole)
    assert iv.measure_words(merged, ["book"]).agg(F.sum("pages")).first()[0] == sum(map(len, pages_of(ranges).values()))


def test_a_range_of_a_billion(spark):
    df = spark.createDataFrame([(1, 5, 1_000_000_004), (1, 0, 9), (2, -(1 << 40), -(1 << 40) + 69)], "k int, a long, b long")
    assert iv.page_words(df, ["k"], "a", "b").count() < 4100
    assert sorted(tuple(r) for r in iv.union_measure(df, ["k"], "a", "b").collect()) == [(1, 1_000_000_005), (2, 70)]


def test_one_book_of_many_ranges_is_split(spark):
    """A million ranges of one book: merged before the shuffle, counted in many tasks, no window in the plan."""
    at = F.col("id") * 7919 % 3_000_000
    hot = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("k"), at.alias("a"), (at + F.col("id") % 40).alias("b"))
    words = iv.page_words(hot, ["k"], "a", "b").withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in words.groupBy("part").count().collect()]
    assert max(sizes) < 0.6 * sum(sizes)
    got = iv.union_measure(hot, ["k"], "a", "b")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.collect() == by_window(hot, ["k"], "a", "b").collect()


def test_empty(spark):
    df = spark.createDataFrame([], "k int, a int, b int")
    assert iv.union_measure(df, ["k"], "a", "b").count() == 0 == iv.overlapping_keys(df, "k", "a", "b").count()


def test_overlaps_of_short_and_long_ranges(spark):
    """Every pair once, whatever the lengths; one range of a billion pages costs some thousand rows."""
    rng = random.Random(4)
    made = lambda n: [(rng.randint(0, 3), k, a, a + rng.choice([-2, 0, 3, 31, 32, 500, 131_071, 131_072, 131_073, 900_000])) for k in range(n) for a in [rng.randint(-1000, 400_000)]]
    old, new = made(120), made(120)
    df = lambda rows, x, y: spark.createDataFrame(rows, f"k int, {x}no int, {x} long, {y} long")
    got = sorted((r["ano"], r["cno"], r["from"], r["to"]) for r in iv.overlaps(df(old, "a", "b"), df(new, "c", "d"), "k", ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j, max(a, c), min(b, d)) for k, i, a, b in old for m, j, c, d in new if k == m and a <= b and c <= d and a <= d and c <= b)
    wide = spark.createDataFrame([(1, 0, 0, 1_000_000_000)], "k int, ano int, a long, b long")
    few = spark.createDataFrame([(1, 1, 999_999_999, 1_000_000_005), (1, 2, -5, -1), (1, 3, 7, 7)], "k int, cno int, c long, d long")
    assert sorted((r["cno"], r["from"], r["to"]) for r in iv.overlaps(wide, few, "k", ("a", "b"), ("c", "d")).collect()) == [(1, 999_999_999, 1_000_000_000), (3, 7, 7)]
