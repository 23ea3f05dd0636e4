"""Periodic runs of words, by heavy and light lag counting.

Words are the runs of characters other than ASCII white space. A run is a stretch
of words with smallest period q (words q apart are alike) and at least
``max(least, folds * q)`` words (``folds`` 2 or more), that no neighbour extends keeping
period q.

A run of period q holds ``max(least, folds * q) - q`` places where a word equals the
one q after it, so only lags with that many matches in the whole text can have one:

1. Matches are counted exactly at every lag up to n / folds. A word in many places is
   heavy: its places are a 0/1 series whose autocorrelation comes from an FFT, and the
   spectra of all heavy words of a text are added before the one transform back. For
   the others the differences of all pairs of places are counted. ``heavy_from`` is the
   number of places where both cost alike.
2. Each lag with enough matches gets an island scan: a stretch of m matches holds four
   places in a row that are multiples of m // 4, so those are looked at first, then
   the places between, and what is left is widened to its ends. Stretches inside a
   run of a period that divides the lag are known, and passed over.

The work is map only. A text is held whole by its task, and takes memory in proportion
to its words; texts are taken in blocks of about ``BLOCK_BYTES``.

Cases: a null, empty or blank text has no words, no run, and the hash of an empty text;
runs of equal length are ordered by start, then period; rows alike and ids of any type
go through row by row; a null id is hashed as an empty text for ``planted``; an empty
table gives an empty result; other columns are not read. A text of n equal words is
one run of period 1.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches

LEAST = 6
FOLDS = 4
BLOCK_BYTES = 1 << 21
#: pairs of places are counted in groups of this many
PAIRS = 1 << 20


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Codes(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def heavy_from(n: np.ndarray) -> np.ndarray:
    """Places of a word in a text of n words from which the FFT is cheaper than all pairs."""
    size = np.maximum(n, 2) * 1.25
    return np.sqrt(0.4 * size * np.log2(size))


def lag_matches(code: np.ndarray, bounds: np.ndarray, most: np.ndarray, heavy_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exact numbers of places i with code[i] == code[i + lag], for lags 0 to ``most`` of each text.

    Text k is ``code[bounds[k]:bounds[k + 1]]``; its counts are ``out[at[k]:at[k + 1]]``.
    """
    n = np.diff(bounds)
    at = np.append(0, np.cumsum(most + 1))
    out = np.zeros(at[-1], np.int64)
    if not len(code):
        return out, at
    heavy_at = heavy_from(n) if heavy_at is None else heavy_at
    doc = np.repeat(np.arange(len(n)), n)
    key = doc * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    owner = doc[order[first]]
    heavy = count > heavy_at[owner]
    for k in np.unique(owner[heavy]).tolist():
        m = 1 << int(n[k] + most[k]).bit_length()
        power = np.zeros(m // 2 + 1)
        for g in np.flatnonzero(heavy & (owner == k)).tolist():
            here = np.zeros(m)
            here[order[first[g] : first[g] + count[g]] - bounds[k]] = 1
            seen = np.fft.rfft(here)
            power += seen.real**2 + seen.imag**2
        out[at[k] : at[k + 1]] += np.rint(np.fft.irfft(power, m)[: most[k] + 1]).astype(np.int64)
        out[at[k]] = 0
    last = np.repeat(first + count, count)
    left = np.flatnonzero(np.repeat(~heavy & (count > 1), count))
    held, step = [], 0
    while len(left):
        step += 1
        left = left[left + step < last[left]]
        lag = order[left + step] - order[left]
        near = lag <= most[doc[order[left]]]
        left, lag = left[near], lag[near]
        held.append(at[doc[order[left]]] + lag)
        if sum(map(len, held)) > PAIRS or not len(left):
            slot, times = np.unique(np.concatenate(held), return_counts=True)
            out[slot] += times
            held = []
    return out, at


def _matches(code: np.ndarray, lag: int, size: int, known: list[Run]) -> Iterator[tuple[int, int]]:
    """Maximal stretches of at least ``size`` places i with code[i] == code[i + lag], outside known runs."""
    n = len(code) - lag
    stride, row = max(1, size // 4), min(4, size)
    probe = np.arange(0, n, stride)
    hit = code[probe] == code[probe + lag]
    for run in known:
        if lag % run.period == 0 and run.length > lag:
            hit[-(-run.start // stride) : -(-(run.start + run.length - lag) // stride)] = False
    if len(hit) < row:
        return
    start = probe[: len(hit) - row + 1][np.lib.stride_tricks.sliding_window_view(hit, row).all(axis=1)]
    gap = stride
    while gap > 1 and len(start):
        half = gap // 2
        offset = np.arange(0, (row - 1) * stride, half)
        for part in np.array_split(offset, max(1, len(offset) * len(start) // PAIRS)):
            place = start[:, None] + part
            start = start[(code[place] == code[place + lag]).all(axis=1)]
        gap = half
    end = 0
    for lo in start.tolist():
        if lo < end:
            continue
        begin, end = _reach(code, lag, lo, -1), _reach(code, lag, lo, 1)
        if end - begin >= size:
            yield begin, end


def _reach(code: np.ndarray, lag: int, place: int, way: int) -> int:
    """The end of the stretch of matches around ``place``: its first place, or the one after its last."""
    step, n = 64, len(code) - lag
    while True:
        lo, hi = (max(0, place - step), place) if way < 0 else (place, min(n, place + step))
        if lo == hi:
            return place
        miss = np.flatnonzero(code[lo:hi] != code[lo + lag : hi + lag])
        if len(miss):
            return lo + int(miss[-1]) + 1 if way < 0 else lo + int(miss[0])
        place, step = (lo if way < 0 else hi), step * 2


def find_runs(code: np.ndarray, bounds: np.ndarray, least: int = LEAST, folds: int = FOLDS) -> list[list[Run]]:
    """The runs of each text, in order of start, then period."""
    n = np.diff(bounds)
    most = np.where(n >= least, n // folds, 0)
    count, at = lag_matches(code, bounds, most)
    lag = np.arange(len(count)) - np.repeat(at[:-1], most + 1)
    slot = np.flatnonzero((lag > 0) & (count >= np.maximum(least, folds * lag) - lag))
    out: list[list[Run]] = [[] for _ in n]
    for k, q in zip((np.searchsorted(at, slot, side="right") - 1).tolist(), lag[slot].tolist(), strict=True):
        known = out[k]
        for lo, hi in _matches(code[bounds[k] : bounds[k + 1]], q, max(least, folds * q) - q, known):
            known.append(Run(lo, hi - lo + q, q))
    for known in out:
        known.sort(key=lambda run: (run.start, run.period))
    return out


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Which words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for run in runs:
        edge[run.start + run.period] += 1
        edge[run.start + run.length] -= 1
    return np.cumsum(edge)[:n] > 0


Change = Callable[[str, list[bytes]], list[bytes]]


def planted(id_text: str, words: list[bytes]) -> list[bytes]:
    """The words with a period planted in the texts of a tenth of the ids, by the id's crc32."""
    h, n = zlib.crc32(id_text.encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"


def collapse(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, folds: int = FOLDS, change: Change | None = None) -> DataFrame:
    """id, n_words, runs in order of start then period, and collapsed: the words that no run holds after its first period.

    ``collapsed`` is UTF-8 with one space between words. ``change`` may alter a text's
    words by its id before they are looked at.
    """
    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def block(ids, texts):
        words = [(x or b"").split() for x in texts]
        if change:
            words = [change(i or "", w) for i, w in zip(ids, words, strict=True)]
        codes = _Codes()
        n = [len(w) for w in words]
        bounds = np.append(0, np.cumsum(n)).astype(np.int64)
        code = np.fromiter((codes[x] for w in words for x in w), np.int64, int(bounds[-1]))
        found = find_runs(code, bounds, least, folds)
        joined = []
        for w, runs in zip(words, found, strict=True):
            keep = w if not runs else [x for x, out in zip(w, dropped(runs, len(w)).tolist(), strict=True) if not out]
            joined.append(b" ".join(keep))
        flat = [run for runs in found for run in runs]
        struct = pa.StructArray.from_arrays([pa.array([run[j] for run in flat], pa.int64()) for j in range(3)], list(Run._fields))
        return pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in found])), pa.int32()), struct), pa.array(joined, pa.binary())

    def run(batches):
        for batch in batches:
            lo = size = 0
            texts = batch.column("text")
            for k in range(batch.num_rows):
                size += len(texts[k].as_py() or b"")
                if size >= BLOCK_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(lo, k + 1 - lo)
                    out = block(part.column("name").to_pylist(), part.column("text").to_pylist())
                    yield pa.record_batch([part.column("id"), *out], ["id", "n_words", "runs", "collapsed"])
                    lo, size = k + 1, 0

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, {FOUND}").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_runs, the longest run and the hashes of all runs and of the collapsed text, with planted periods."""
    found = collapse(docs, id_col, text, change=planted)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    longest = F.when(F.size("runs") > 0, longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        F.col(f"`{id_col}`"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.s").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.p").alias("period"),
        F.floor(F.expr("-1000 * top.l div top.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
