"""The trigram join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fuzzy


def grams(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return frozenset(f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1))


def rank(a, b):
    return float(np.float32(len(a & b) / len(a | b)))


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(3)
    words = ["sea", "seas", "season", "war", "peace", "a", "The", "the", "history", "historia", "ÉTÉ", "été", "of", "x1", "x2"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    return [*enumerate(made), (200, None), (201, ""), (202, " -- "), (203, "sea" * 300), (None, "peace war"), (None, "only here"), *((300 + k, "The sea") for k in range(30))]


def classes(rows):
    out = {}
    for i, t in rows:
        if grams(t):
            out.setdefault(grams(t), []).append(i)
    return out


@pytest.mark.parametrize("above", [0.0, 0.3, 0.5, 0.8])
def test_all_pairs_of_classes(spark, titles, above):
    df = spark.createDataFrame(titles, "id long, title string").repartition(3)
    got = sorted(((r["id"], r["copies"]), (r["other"], r["other_copies"]), round(r["rank"], 6)) for r in fuzzy.similar_titles(df, "id", "title", above).fillna(-1).collect())
    least = lambda ids: min((i for i in ids if i is not None), default=-1)
    c = [(g, least(ids), len(ids)) for g, ids in classes(titles).items()]
    want = []
    for k, (g, i, n) in enumerate(c):
        for h, j, m in c[:k]:
            if rank(g, h) > above:
                pair = sorted([(i, n), (j, m)], key=lambda p: (p[0] == -1, p[0]))
                want.append((*pair, round(rank(g, h), 6)))
    assert got == sorted(want)


@pytest.mark.parametrize("above", [0.3, 0.7])
def test_matches(spark, titles, above):
    df = spark.createDataFrame([(i, t, 1) for i, t in titles], "id long, title string, n int")
    wanted = df.filter("id % 5 = 0")
    got = sorted((r["wanted"], -1 if r["found"] is None else r["found"], round(r["rank"], 6)) for r in fuzzy.match_titles(wanted, df, "id", "title", above).collect())
    want = []
    for i, t in titles:
        if i is not None and i % 5 == 0 and grams(t):
            want += [(i, -1 if j is None else j, round(rank(grams(t), grams(u)), 6)) for j, u in titles if grams(u) and rank(grams(t), grams(u)) > above]
    assert got == sorted(want)


def test_no_cross_join_and_string_ids(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "one two four"), ("c", "else")], "code string, name string")
    out = fuzzy.similar_titles(df, "code", "name", 0.3)
    assert [(r["id"], r["other"]) for r in out.collect()] == [("a", "b")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert fuzzy.similar_titles(df.limit(0), "code", "name").count() == 0


def test_copies_are_compared_once(spark):
    """50,000 copies of two titles: two classes, one pair."""
    df = spark.range(50_000).selectExpr("id", "if(id % 2 = 0, 'the old sea', 'the old seas') as t")
    assert [tuple(r)[:4] for r in fuzzy.similar_titles(df, "id", "t").collect()] == [(0, 25_000, 1, 25_000)]


def test_matches_of_copies_are_made_by_several_tasks(spark):
    """20 wanted copies of a title and 400 of the catalogue, in one file's partition: all pairs, dealt out."""
    df = spark.range(0, 400, 1, 1).selectExpr("id", "if(id = 7, null, 'The sea') as t")
    out = fuzzy.match_titles(df.filter("id % 20 = 0"), df, "id", "t", 0.7, digits=5)
    assert out.schema["rank"].dataType.typeName() == "double" and out.distinct().count() == 20 * 399
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_copies_are_cut_into_trigrams_once(spark):
    """Below the grouping by title nothing is lowered or split, not even for a filter."""
    df = spark.createDataFrame([(1, "a sea"), (2, "a sea"), (3, "--"), (4, None)], "id long, t string")
    sets = fuzzy.gram_sets(df, "id", "t")
    assert [(r["id"], r["copies"]) for r in sets.collect()] == [(1, 2)]
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate ") :].split("\n", 1)[1]
    assert "lower(" in plan and "lower(" not in below
