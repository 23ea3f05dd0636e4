"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A column is cut into blocks of whole texts; a block's bytes lie in one numpy
array, so that word boundaries and hashes of any substring cost a few
nanoseconds a byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Block(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch; text ``k`` is ``data[bounds[k]:bounds[k + 1]]``."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


def byte_view(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``limit`` bytes, or of one text where that is longer."""
    data, at = byte_view(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Block(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n + 1, np.uint64), 1
    while done <= n:
        m = min(done, n + 1 - done)
        out[done : done + m] = out[:m] * np.uint64(pow(base, done, 1 << 64))
        done += m
    return out


class Roller:
    """64-bit names of substrings, from one prefix sum a block.

    The name of ``b[0..n)`` is ``mix(sum(T[b[j]] * r**j))`` modulo 2**64 with a
    random odd ``r`` and a random table ``T``; it depends on the bytes only.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 1 << 62)) * 4 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        return self.sums(self.table[data])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over any 64-bit values in place of bytes."""
        if len(self.up) <= len(values):
            n = max(len(values), BLOCK_BYTES)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def names(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def word_spans(block: Block, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, or other bytes ``between`` words; no run crosses texts."""
    full = ~between[block.data]
    n = len(full)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    first = block.bounds[:-1]
    before[first[first < n]] = False
    last = block.bounds[1:]
    after[last[last > 0] - 1] = False
    return np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Names of ``k`` words in a row, one for each word that starts such a run."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(out)


def signed(h: np.ndarray) -> pa.Array:
    """As a bigint column."""
    return pa.array(h.view(np.int64))


class Letters(NamedTuple):
    """Code points of a block: lower-case letters, and 0 for all else.

    Text ``k`` is ``code[bounds[k]:bounds[k + 1]]``.
    """

    code: np.ndarray
    bounds: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


_LOWER: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """By code point: its lower-case form if it is a letter, else 0."""
    if not _LOWER:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LOWER.append(out)
    return _LOWER[0]


def letters(block: Block) -> Letters:
    raw = block.data.tobytes()
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=first[1:])
    return Letters(_lower_letters()[code], first[block.bounds])
