"""Suffix-array dedup of long byte strings with a difference cover.

Goal: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else. Only suffixes cut to ``LENGTH`` bytes matter, and of their order only which
are equal. A difference cover D modulo V (Colbourn and Ling's) has, for any two
positions i and j, a shift s < V so that i + s and j + s are both cover positions.

1. Texts alike are collapsed to one in chunks of texts (``_chunks``), so that groups
   of copies weigh as one text.
2. Cover sample: the positions p with p mod V in D are named by their next
   LENGTH - V + 1 bytes. Each slice of the names finds those that are met twice.
   Equal strings at i and j hold equal sample names at i + s and j + s, so a suffix
   with no repeated sample in its first V positions is unique and is sorted nowhere.
3. Suffix buckets: the others are named by all their LENGTH bytes and dealt into
   buckets by range of names. One task sorts one bucket at a time; ties of the first
   64 bits are resolved by 32 more of an independent hash, and neighbours that are
   equal are repeated. A bucket returns one bit a name to the chunk it came from.
4. The spans of repeated suffixes are united and cut out of the text.

A chunk sends each of its names once, so a passage in very many texts is sent once a
chunk and not once a text. The numbers of chunks, slices and buckets follow the input;
nothing is broadcast. A bucket is in order of name, not lexicographic; equality is what
is asked for. The sample only decides which suffixes are sorted: its names may be short,
and a false hit costs a sorted suffix, never a byte.

Cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose
nothing; rows with one id are separate texts, and two rows alike repeat each other;
an empty table gives an empty result. Texts are cut at bytes: what is kept of one
need not be valid UTF-8, so ``dedup`` returns it as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks
from ._spark import cut, slices_for, small_batches
from ._text import Roller, blocks

LENGTH = 400
CHUNK_BYTES = 1 << 20
SLICE_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """Colbourn and Ling: V = 24 r^2 + 36 r + 13 and 6 r + 4 positions."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


V, COVER = difference_cover(2)


class Text(NamedTuple):
    """One text of a chunk: its bytes at ``at`` of a block with these prefix sums."""

    row: int
    data: np.ndarray
    block: np.ndarray
    sums: np.ndarray
    at: int


class Suffixes:
    """Names of cover samples and of suffixes, text by text."""

    def __init__(self, length: int, v: int, cover: np.ndarray):
        self.length, self.v, self.cover = length, v, cover
        self.sampled = length - v + 1
        self.roller, self.second = Roller(61), Roller(67)

    def texts(self, column) -> Iterator[Text]:
        """The texts that are long enough."""
        for block in blocks(column):
            sums = self.roller.prefix(block.data)
            for k in range(block.hi - block.lo):
                a, b = block.bounds[k], block.bounds[k + 1]
                if b - a >= self.length:
                    yield Text(block.lo + k, block.data[a:b], block.data, sums, a)

    def sample(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions whose sampled bytes lie inside the text, and their names."""
        n = len(text.data)
        base = np.arange(0, n - self.sampled + 1, self.v)
        at = (base[:, None] + self.cover[None, :]).ravel()
        at = at[at <= n - self.sampled]
        return at, self.roller.names(text.sums, at + text.at, at + text.at + self.sampled)

    def candidates(self, n: int, hit: np.ndarray) -> np.ndarray:
        """Starts of suffixes with a repeated sample, at ``hit``, in their first ``v`` positions."""
        if not len(hit):
            return hit
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, np.maximum(hit - self.v + 1, 0), 1)
        np.add.at(mark, hit + 1, -1)
        return np.flatnonzero(np.cumsum(mark[: n - self.length + 1]) > 0)

    def names(self, text: Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of each suffix."""
        first = self.roller.names(text.sums, at + text.at, at + text.at + self.length)
        return first, (self.second.names(self.second.prefix(text.data), at, at + self.length) >> np.uint64(32)).astype(np.uint32)


def _one_each(table: pa.Table) -> pa.Table:
    """One row a digest, in order of digest, with whether there were more."""
    digests = table.column("digest").to_pylist()
    again = table.column("again").to_pylist()
    first = [k for k, d in enumerate(digests) if not k or digests[k - 1] != d]
    many = [b - a > 1 or any(again[a:b]) for a, b in zip(first, [*first[1:], len(digests)], strict=True)]
    return table.take(pa.array(first, pa.int64())).set_column(2, "again", pa.array(many, pa.bool_()))


def _texts(docs: DataFrame, text: str, length: int) -> DataFrame:
    """Chunks of (digest, text, again) of the texts that are long enough, one row a text."""
    count = slices_for(docs, CHUNK_BYTES, 64, 1 << 30)
    t = F.col(f"`{text}`")
    rows = docs.filter(F.octet_length(t) >= length).select(F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int").alias("c"), "digest", "text")

    def once(batches):
        """A task sends each text once, and that it has met it again."""
        seen: dict[bytes, bool] = {}
        where: dict[bytes, int] = {}
        for batch in batches:
            c, new = batch.column(0).to_numpy(), np.zeros(batch.num_rows, bool)
            for k, d in enumerate(batch.column(1).to_pylist()):
                if d in seen:
                    seen[d] = True
                    where[d] = int(c[k])
                else:
                    seen[d] = False
                    new[k] = True
            kept = batch.filter(pa.array(new))
            yield pa.record_batch([*kept.columns, pa.array([False] * kept.num_rows, pa.bool_())], ["c", "digest", "text", "again"])
        more = list(where)
        yield pa.record_batch([pa.array([where[d] for d in more], pa.int32()), pa.array(more, pa.binary()), pa.nulls(len(more), pa.string()), pa.array([True] * len(more), pa.bool_())], ["c", "digest", "text", "again"])

    return _chunks.chunked(rows.mapInArrow(once, "c int, digest binary, text string, again boolean"), ("digest", "again"), _one_each)


class _Chunk:
    """The texts of a chunk with their samples, and the suffixes that may repeat."""

    def __init__(self, suffixes: Suffixes, columns: list[pa.Array], bits: int):
        self.suffixes = suffixes
        self.digests, column, again = columns
        self.again = again.to_numpy(zero_copy_only=False)
        self.texts = list(suffixes.texts(column))
        found = [suffixes.sample(t) for t in self.texts]
        self.at = [x[0] for x in found]
        self.sizes = [len(x) for x in self.at]
        names = _chunks.cut_names(np.concatenate([np.empty(0, np.uint64), *(x[1] for x in found)]), bits)
        many = np.repeat(np.array([self.again[t.row] for t in self.texts], bool), self.sizes)
        self.names, self.place, self.many = _distinct(names, many)

    def hits(self, parts, bits: int) -> list[np.ndarray]:
        """Starts of the suffixes to sort, by text."""
        hit = np.split(_chunks.lookup(self.names, parts, bits)[self.place], np.cumsum(self.sizes)[:-1]) if self.texts else []
        return [self.suffixes.candidates(len(t.data), at[h]) for t, at, h in zip(self.texts, self.at, hit, strict=True)]

    def sorted(self, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of the suffixes, their further bits, the place of each suffix among them, and marks."""
        found = [self.suffixes.names(t, at) for t, at in zip(self.texts, starts, strict=True) if len(at)]
        first = np.concatenate([np.empty(0, np.uint64), *(x[0] for x in found)])
        second = np.concatenate([np.empty(0, np.uint32), *(x[1] for x in found)])
        many = np.repeat(np.array([self.again[t.row] for t in self.texts], bool), [len(at) for at in starts])
        return _distinct(first, many, second)


def _distinct(names: np.ndarray, many: np.ndarray, more: np.ndarray | None = None):
    """Sorted distinct names (with ``more``), the place of each, and whether it is there twice or marked."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if more is not None:
        rank = more[order]
        if ((rank[1:] != rank[:-1]) & ~new[1:]).any():
            order = np.lexsort((more, names))
            s, rank = names[order], more[order]
            new[1:] = (s[1:] != s[:-1]) | (rank[1:] != rank[:-1])
    first = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    marked = np.diff(np.append(first, len(s))) > 1
    if many.any():
        marked[place[many]] = True
    return (s[first], place, marked) if more is None else (s[first], rank[first], place, marked)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, r: int = 2, keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept (binary) and spans.

    Texts meet what they lose by their digest; those that lose nothing are not moved.
    """
    small_batches(docs)
    v, cover = difference_cover(r)
    if length < 2 * v:
        raise ValueError("the cover's period must be at most half the length")
    bits = slices_for(docs, SLICE_BYTES, 16, 1 << 24).bit_length() - 1
    bucket_bits = slices_for(docs, BUCKET_BYTES, 16, 1 << 24).bit_length() - 1
    texts = _texts(docs, text, length)

    def ask_samples(batches):
        suffixes = Suffixes(length, v, cover)
        for c, columns, _ in _chunks.chunk_rows(batches):
            chunk = _Chunk(suffixes, columns, bits)
            yield _chunks.asks(c, chunk.names, chunk.many, bits, width=4)

    samples = cut(_chunks.answered(texts.mapInArrow(ask_samples, _chunks.ASKS), _chunks.met_twice, width=4))

    def ask_suffixes(batches):
        suffixes = Suffixes(length, v, cover)
        for c, columns, (parts,) in _chunks.chunk_rows(batches):
            chunk = _Chunk(suffixes, columns, bits)
            first, second, _, many = chunk.sorted(chunk.hits(parts, bits))
            yield _chunks.asks(c, first, many, bucket_bits, more=second)

    # the chunks lie by bucket of c already, so only the answers move
    sampled = texts.join(samples.hint("merge"), "c")
    repeated = cut(_chunks.answered(sampled.mapInArrow(ask_suffixes, _chunks.ASKS), _chunks.met_twice))

    def spans(size: int, starts: np.ndarray) -> list[tuple[int, int]]:
        far = np.flatnonzero(np.diff(starts) > length)
        return list(zip(starts[np.append(0, far + 1)].tolist(), (starts[np.append(far, len(starts) - 1)] + length).tolist(), strict=True))

    more = ", kept binary, spans array<struct<a: long, b: long>>" if keep_text else ""

    def finish(batches):
        suffixes = Suffixes(length, v, cover)
        for _, columns, (parts, answers) in _chunks.chunk_rows(batches):
            chunk = _Chunk(suffixes, columns, bits)
            starts = chunk.hits(parts, bits)
            first, _, place, _ = chunk.sorted(starts)
            hit = np.split(_chunks.lookup(first, answers, bucket_bits)[place], np.cumsum([len(x) for x in starts])[:-1])
            rows: list[list] = [[], [], [], [], [], []]
            for t, at, h in zip(chunk.texts, starts, hit, strict=True):
                size = len(t.data)
                lost = [(0, size)] if chunk.again[t.row] else spans(size, at[h]) if h.any() else []
                if lost:
                    raw, end, kept = t.data.tobytes(), 0, []
                    for a, b in lost:
                        kept.append(raw[end:a])
                        end = b
                    kept = b"".join([*kept, raw[end:]])
                    for column, x in zip(rows, (chunk.digests[t.row].as_py(), sum(b - a for a, b in lost), len(lost), hashlib.sha256(kept).hexdigest(), kept, [{"a": a, "b": b} for a, b in lost]), strict=True):
                        column.append(x)
            out = [pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string())]
            names = ["key", "removed", "spans_", "sha"]
            if keep_text:
                out += [pa.array(rows[4], pa.binary()), pa.array(rows[5], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.record_batch(out, names)

    both = sampled.join(repeated.withColumnRenamed("parts", "answers").hint("merge"), "c")
    lost = cut(both.mapInArrow(finish, f"key binary, removed long, spans_ long, sha string{more}"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("whole"), *([t.alias("text")] if keep_text else []))
    slim = slim.withColumn("digest", F.unhex("whole"))
    out = slim.join(lost, F.col("digest") == F.col("key"), "left")
    zero = F.lit(0).cast("long")
    columns = [F.col("id").alias(id_col), "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans_", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")]
    if keep_text:
        columns += [F.coalesce("kept", F.col("text").cast("binary")).alias("kept"), F.coalesce("spans", F.array().cast("array<struct<a: long, b: long>>")).alias("spans")]
    return out.select(*columns)
