"""Benchmark decontamination by SimHash windows.

For each benchmark item, a document is searched with windows of the item's size
in words. Windows and items have 64-bit SimHash fingerprints over their weighted
shingles of five words. The items of one size are indexed by the 8 blocks of
their fingerprints: two fingerprints within ``RADIUS`` bits differ by at most
``RADIUS // 8`` bits in some block, so looking each block up with that many bits
free finds every fingerprint within the radius. Candidates are verified by the
exact weighted Jaccard similarity of the shingles of window and item.

A window that shares no shingle with any item of its size has similarity 0, so every
window that shares one gets a fingerprint and the others need none; this drops no match,
and it is left to the fingerprints to find the candidates among them.

The benchmark goes to the executors in parts of at most ``PART_ITEMS`` items and
``PART_CHARS`` characters; a larger benchmark takes more passes. One part is held at a
time: what a pass has found is written before the next part is sent.

Cases: null and empty texts match nothing; items of fewer than five words have one
shingle of all their words and match documents of exactly those words; a document
shorter than an item is one window; items alike are all reported; rows with one id
are searched one by one and the best similarity is reported; items with a null id
are searched too and reported with a null item_id, all as one; an empty table of
either kind gives no pairs. ``clean`` keeps all columns.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, small_batches
from ._text import Block, Roller, blocks, combine, mix, word_spans

SHINGLE = 5
LEAST = 0.8
RADIUS = 24
PART_ITEMS = 20_000
PART_CHARS = 16 << 20
SEED = 47
GATE = 1 << 22
#: windows that are fingerprinted at a time
STRETCH = 4096


class Words(NamedTuple):
    """Shingles of a block: hash, document, and the document's first shingle."""

    h: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def shingled(block: Block, roller: Roller) -> Words:
    """As many shingles a text as windows of five words; one for shorter texts."""
    start, end = word_spans(block)
    words = roller.names(roller.prefix(block.data), start, end)
    doc = block.doc_of(start)
    h = combine(words, SHINGLE)
    m = len(h)
    same = doc[:m] == doc[SHINGLE - 1 :][:m]
    at = np.searchsorted(doc, np.arange(len(block.bounds)))
    n = np.diff(at)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    short = [combine(words[at[d] : at[d + 1]], int(n[d]))[0] ^ np.uint64(n[d]) for d in few]
    h, owner = np.append(h[same], np.array(short, np.uint64)), np.append(doc[:m][same], few)
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    return Words(h, owner, np.searchsorted(owner, np.arange(len(block.bounds))))


def _signs(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1."""
    bits = np.unpackbits(mix(h ^ np.uint64(0x5DEECE66D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """(windows, 8) bytes: SimHash of each window of ``size`` shingles."""
    total = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_signs(h), axis=0, out=total[1:])
    return np.packbits(total[size:] - total[:-size] > 0, axis=1)


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)


class Index:
    """Items of one size, by the blocks of their fingerprints."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= radius // 8
        #: for each block, the items whose byte is near, byte by byte, and where those of each byte start
        self.near = []
        for b in range(8):
            byte, items = np.nonzero(near[:, prints[:, b]])
            self.near.append((np.searchsorted(byte, np.arange(257)), items))

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, item) within the radius, in order of query."""
        seen = np.empty(0, np.int64)
        for b in range(8):
            start, items = self.near[b]
            n = start[query[:, b].astype(np.int64) + 1] - start[query[:, b]]
            of = np.repeat(np.arange(len(query)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[query[:, b]], n)
            seen = np.union1d(seen, of * len(self.prints) + items[at])
        q, item = seen // max(1, len(self.prints)), seen % max(1, len(self.prints))
        far = POPCOUNT[self.prints[item] ^ query[q]].sum(axis=1)
        return q[far <= self.radius], item[far <= self.radius]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser counts over the sum of the greater."""
    ha, na = np.unique(a, return_counts=True)
    hb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(na[i], nb[j]).sum()
    return float(both / (len(a) + len(b) - both))


class Benchmark:
    """Items of one part, ready to search with."""

    def __init__(self, ids: list[int], texts: list[str], least: float = LEAST, radius: int = RADIUS):
        self.least = least
        self.roller = Roller(SEED)
        self.ids, self.shingles = [], []
        column = pa.array(texts, pa.string())
        for block in blocks(column):
            words = shingled(block, self.roller)
            for k in range(block.hi - block.lo):
                h = words.h[words.first[k] : words.first[k + 1]]
                if len(h):
                    self.ids.append(ids[block.lo + k])
                    self.shingles.append(h)
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *self.shingles]))
        self.gate = np.zeros(GATE, bool)
        self.gate[(self.known & np.uint64(GATE - 1)).astype(np.int64)] = True
        self.counted = [np.unique(h, return_counts=True) for h in self.shingles]
        by_size: dict[int, list[int]] = {}
        for k, h in enumerate(self.shingles):
            by_size.setdefault(len(h), []).append(k)
        self.groups = [(s, np.array(ks), Index(np.concatenate([fingerprints(self.shingles[k], s) for k in ks]), radius)) for s, ks in sorted(by_size.items())]
        #: the groups that have an item with a known shingle, shingle by shingle, and where those of each start
        pairs = [np.searchsorted(self.known, np.concatenate([self.shingles[k] for k in ks])) * len(self.groups) + g for g, (_, ks, _) in enumerate(self.groups)]
        pairs = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]))
        self.held_by = pairs % max(1, len(self.groups))
        self.held_at = np.searchsorted(pairs // max(1, len(self.groups)), np.arange(len(self.known) + 1))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that an item has, and their places among the known ones."""
        at = np.flatnonzero(self.gate[(h & np.uint64(GATE - 1)).astype(np.int64)])
        if not len(self.known):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        same = self.known[place] == h[at]
        return at[same], place[same]

    def similarities(self, h: np.ndarray, at: np.ndarray, width: int, item: int) -> np.ndarray:
        """Exact weighted Jaccard of the windows at ``at`` with an item.

        Where no shingle of the item is met twice in the stretch, and the item has each once,
        the lesser counts are a running sum; else window by window.
        """
        values, counts = self.counted[item]
        lo = int(at.min())
        stretch = h[lo : int(at.max()) + width]
        place = np.minimum(np.searchsorted(values, stretch), len(values) - 1)
        met = values[place] == stretch
        if counts.max() > 1 or np.bincount(place[met], minlength=1).max() > 1:
            return np.array([weighted_jaccard(h[x : x + width], self.shingles[item]) for x in at.tolist()])
        upto = np.append(0, np.cumsum(met))
        both = upto[at - lo + width] - upto[at - lo]
        return both / (width + len(self.shingles[item]) - both)

    def search(self, h: np.ndarray, at: np.ndarray, place: np.ndarray) -> dict[int, tuple[float, int]]:
        """For one document's shingles, of which items have those at ``at``: item -> (best similarity, its first shingle)."""
        best: dict[int, tuple[float, int]] = {}
        n = self.held_at[place + 1] - self.held_at[place]
        group = self.held_by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.held_at[place], n)]
        at = np.repeat(at, n)
        for g in np.unique(group).tolist():
            size, items, index = self.groups[g]
            hits, width = at[group == g], min(size, len(h))
            if width < self.least * size:
                continue
            start = np.zeros(len(h) - width + 2, np.int64)
            np.add.at(start, np.maximum(hits - width + 1, 0), 1)
            np.add.at(start, np.minimum(hits, len(h) - width) + 1, -1)
            windows = np.flatnonzero(np.cumsum(start[:-1]) > 0)
            for run in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1) if len(windows) else []:
                for lo in range(0, len(run), STRETCH):
                    some = run[lo : lo + STRETCH]
                    query, found = index.search(fingerprints(h[some[0] : some[-1] + width], width))
                    for k in np.unique(found).tolist():
                        near = some[query[found == k]]
                        s = self.similarities(h, near, width, items[k])
                        top = int(s.argmax())
                        if s[top] >= self.least - 1e-12 and s[top] > best.get(items[k], (0.0, 0))[0]:
                            best[items[k]] = (float(s[top]), int(near[top]))
        return best

    def matches(self, column):
        """(row, item id, similarity, first word) of a column of texts."""
        for block in blocks(column):
            words = shingled(block, self.roller)
            hits, place = self.hits(words.h)
            owner = words.doc[hits]
            for d in np.unique(owner):
                a, b = words.first[d], words.first[d + 1]
                mine = owner == d
                for item, (s, at) in self.search(words.h[a:b], hits[mine] - a, place[mine]).items():
                    yield block.lo + int(d), self.ids[item], s, at


def _parts(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark in parts of bounded size: (ids, texts)."""
    ids, texts, chars = [], [], 0
    for r in benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).filter("t is not null").toLocalIterator():
        if ids and (len(ids) >= PART_ITEMS or chars + len(r["t"]) > PART_CHARS):
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        chars += len(r["t"])
    yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """id, item_id, similarity, first_word: pairs of a document and an item that it holds."""
    small_batches(docs)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = None
    for part in _parts(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            bench = Benchmark(*shared.value, least=least)
            for batch in batches:
                rows = list(bench.matches(batch.column(1)))
                at, items, s, first = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int64()), pa.array(s, pa.float64()), pa.array(first, pa.int64())], ["id", "item_id", "similarity", "first_word"])

        found = cut(slim.mapInArrow(run, f"id {kind}, item_id long, similarity double, first_word long"))
        shared.destroy()
        out = found if out is None else out.union(found)
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("similarity", -F.col("first_word"))).alias("x"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.col2")).alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no item; each row is judged where it lies."""
    small_batches(docs)
    at, schema = docs.columns.index(text), docs.schema
    held = None
    for part in _parts(benchmark, item_id, item_text):
        if held is not None:
            docs = cut(docs)
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=held):
            bench = Benchmark(*shared.value, least=least)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in bench.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
