"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic
from tessera.llm.periodic import Run
from tessera.llm.queries import QUERIES


def brute(words, least=6, folds=4):
    found = {}
    for q in range(1, len(words) // folds + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, folds * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((Run(s, n, q) for (s, n), q in found.items()), key=lambda r: (r.start, r.period))


def blocks_of(texts):
    return np.array([x for t in texts for x in t], np.int64), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def some_text(rng, most=300):
    out = []
    while rng.random() < 0.85 and len(out) < most:
        out += [rng.randint(0, rng.choice([1, 2, 5, 60])) for _ in range(rng.randint(1, 12))] * rng.randint(1, rng.choice([2, 6, 30]))
    return out[: rng.randint(0, most)]


@pytest.mark.parametrize(("least", "folds"), [(6, 4), (3, 2), (9, 3)])
def test_runs(least, folds):
    rng = random.Random(least)
    for _ in range(150):
        texts = [some_text(rng) for _ in range(rng.randint(1, 4))]
        assert periodic.find_runs(*blocks_of(texts), least, folds) == [brute(t, least, folds) for t in texts]


@pytest.mark.parametrize("heavy_at", [0, 5, 10**9])
def test_lag_matches_are_exact(heavy_at):
    """All words heavy, some, none: the same numbers."""
    rng = random.Random(2)
    texts = [some_text(rng) for _ in range(20)] + [[], [7], [rng.randint(0, 30) for _ in range(3000)]]
    code, bounds = blocks_of(texts)
    most = np.diff(bounds) // 4
    count, at = periodic.lag_matches(code, bounds, most, np.full(len(texts), heavy_at))
    for k, t in enumerate(texts):
        assert count[at[k] : at[k + 1]].tolist() == [0] + [sum(a == b for a, b in zip(t, t[q:], strict=False)) for q in range(1, len(t) // 4 + 1)]


@pytest.mark.parametrize("unit", [[1], [1, 2], [1, 1, 2], list(range(997))])
def test_long_text_of_one_period(unit):
    """200,000 words: multiples of the period are not scanned again."""
    n = 200_000
    code = np.array((unit * (n // len(unit) + 1))[:n], np.int64)
    assert periodic.find_runs(code, np.array([0, n]))[0][-1] == Run(0, n, len(unit))


def test_planted():
    words = [b"%d" % k for k in range(50)]
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = periodic.planted(str(hit), words)
    g = zlib.crc32(str(hit).encode()) // 10
    a, p = g % 50, 1 + (50 - g % 50) // (3 + g % 8)
    assert out == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert periodic.planted(str(hit), []) == [] and periodic.planted(str(hit + 1), words) in (words, periodic.planted(str(hit + 1), words))


def expected(doc_id, text, change=True):
    words = (text or "").encode().split()
    if change:
        words = periodic.planted("" if doc_id is None else str(doc_id), words)
    runs = brute(words)
    keep = [w for i, w in enumerate(words) if not any(r.start + r.period <= i < r.start + r.length for r in runs)]
    top = min(runs, key=lambda r: (-r.length, r.start, r.period), default=None)
    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    head = (top.start, top.length, top.period, 1000 * top.length // top.period) if top else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest())


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "la " * 5), (6, "la " * 6), (7, "la " * 6), (7, "la " * 6), (None, "a b " * 20), (8, "é ß " * 30),
    (9, "a a a a a a b " * 9), (10, ("one two three " * 5) + ("z " * 8) + ("four five " * 9)), (11, "same " * 4000), (12, "w" * 9000 + " x" * 7),
]


def test_awkward(spark):
    docs = spark.createDataFrame([(i, t, 3, "r", "c") for i, t in AWKWARD], "doc_id long, text string, n_words long, runs string, collapsed string").repartition(2)
    got = sorted((tuple(r) for r in periodic.digest(docs).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in AWKWARD), key=str)
    assert periodic.digest(docs.limit(0)).count() == 0


def test_collapse_keeps_the_text(spark):
    docs = spark.createDataFrame([("p", "go on " * 10 + "now"), ("q", None)], "name string, body string")
    got = {r["name"]: r for r in periodic.collapse(docs, "name", "body").collect()}
    assert bytes(got["p"]["collapsed"]) == b"go on now" and got["p"]["n_words"] == 21
    assert [tuple(r) for r in got["p"]["runs"]] == [(0, 20, 2)]
    assert bytes(got["q"]["collapsed"]) == b"" and got["q"]["runs"] == []


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    short = [r for r in docs if len((r["text"] or "").split()) < 3000]
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])
