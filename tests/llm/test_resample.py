"""Importance resampling: hashes, n-gram runs, ranks, and the whole against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import resample
from tessera.llm._text import blocks
from tessera.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text, sizes=3):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, sizes + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets=10_000, percent=5, least=20):
    """By row number: n_features, weight, score; and the drawn rows in order."""

    def hashed(text):
        return [zlib.crc32(f.encode()) % buckets for f in features_of(text)]

    own, aim = [hashed(t) for _, t in docs], Counter(b for t in target for b in hashed(t))
    seen = Counter(b for f in own for b in f)
    s_all, t_all = sum(seen.values()), sum(aim.values())
    rows = []
    for (i, text), f in zip(docs, own, strict=True):
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((seen[b] + 1) * (t_all + buckets)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [k for k, (_, text) in enumerate(docs) if len(words_of(text)) >= least]
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    return rows, able[: percent * len(able) // 100]


def test_join_crc():
    rng = random.Random(1)
    for n in (0, 1, 7, 63, 64, 200, 1000):
        a, b = rng.randbytes(rng.randint(0, 30)), rng.randbytes(n)
        got = resample.join_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("limit", [1, 40, 10_000])
def test_runs_enumerate_every_ngram_once(limit):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "é1", "x" * 90, "_", "ab"]) for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None, "", "-- !", "one"]
    want = Counter(f for t in texts for f in features_of(t))
    got = Counter()
    for block in blocks(pa.array(texts), limit):
        found = resample.Runs(block)
        seen = set()
        for n in (1, 2, 3) if found.count else ():
            places, first, length = found.runs(n)
            assert int(length.sum()) == len(places)
            for place, times, crc in zip(places[first].tolist(), length.tolist(), found.crc(places[first], n).tolist(), strict=True):
                assert (n, crc) not in seen
                seen.add((n, crc))
                got[n, crc] += times
    again = Counter()
    for f, times in want.items():
        again[f.count(" ") + 1, zlib.crc32(f.encode())] += times
    assert got == again


def test_deep_keys_without_packing():
    """More different words than three of them fit into 63 bits go through lexsort."""
    text = "a b a b c a b a b"
    block = next(blocks(pa.array([text])))
    one, other = resample.Runs(block), resample.Runs(block, 40)
    for n in (1, 2, 3):
        assert [x.tolist() for x in one.runs(n)[1:]] == [x.tolist() for x in other.runs(n)[1:]]


def test_ranked(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), i) for i in range(500)] + [(3, 1000)] * 40 + [(2, None)] * 3
    df = spark.createDataFrame(rows, "score long, id long").repartition(5)
    got = resample.ranked(df, F.col("score").desc(), F.col("id").asc_nulls_last()).collect()
    assert sorted(r["place"] for r in got) == list(range(1, len(rows) + 1))
    got = [(-r["score"], r["id"] is None, r["id"] or 0) for r in sorted(got, key=lambda r: r["place"])]
    assert got == sorted(got)


AWKWARD = [(1, None), (2, ""), (3, " \t\n-"), (4, "x"), (5, "Ünï code ß " * 9), (None, "a b c " * 30), (6, "a b c " * 30), (6, "a b c " * 30), (7, "word " * 5000), (8, "q" * 5000 + " z" * 30)]


def test_awkward_against_brute_force(spark):
    rng = random.Random(4)
    rows = AWKWARD + [(100 + k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    target = ["aa bb cc aa", None, "", "a b c"]
    docs = spark.createDataFrame([(i, t, 1, "y", 0.5) for i, t in rows], "doc_id long, text string, rank long, id string, part double").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(tuple(r) for r in resample.draw(docs, aim).select("doc_id", "n_features", "weight", "score").fillna(-1).collect())
    want, picked = brute(rows, target)
    assert got == sorted((-1 if i is None else i, *rest) for i, *rest in want)
    drawn = [r["doc_id"] for r in sorted(resample.draw(docs, aim).filter("rank is not null").collect(), key=lambda r: r["rank"])]
    assert drawn == [want[k][0] for k in picked]


def test_string_ids_empty_tables(spark):
    docs = spark.createDataFrame([(f"d{k:02}", f"w{k} " * 25) for k in range(40)], "name string, body string")
    aim = spark.createDataFrame([("w7",)], "body string")
    got = resample.draw(docs, aim, "name", "body").collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 40
    assert resample.draw(docs.limit(0), aim, "name", "body").count() == 0
    assert resample.draw(docs, aim.limit(0), "name", "body").count() == 40


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, picked = brute([tuple(r) for r in docs], target)
    rank = {k: j + 1 for j, k in enumerate(picked)}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_importance"](spark, sf).collect()}
    assert got == {row[0]: (*row, rank.get(k)) for k, row in enumerate(want)}
