"""Chunks of rows that ask about names, and slices of names that answer.

A question such as "which of my names occur elsewhere too?" is asked by chunk, and
answered by slice of the 64-bit names, so that neither side holds more than its
share and nothing is broadcast:

1. ``chunked`` deals rows into chunks of about one size, a row of a table each. The
   table is bucketed by chunk: answers come to it without moving the rows again.
2. Each chunk sends its distinct names, sorted, to the slices of their leading bits.
   A name that many texts share is sent once a chunk.
3. ``answered`` gives each slice to one task, which returns one bit a name.
4. The chunk, which can make its names again, reads the bits with ``lookup``.

The numbers of chunks and of slices follow the input, so the memory of a task does not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import TABLES, note_written, shared_folder

Find = Callable[[list[np.ndarray], list["np.ndarray | None"], list[np.ndarray]], list[np.ndarray]]


def chunked(rows: DataFrame, order: tuple[str, ...] = (), tidy: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """(c, rows) from rows with a column ``c``: one row a chunk, bucketed by ``c``.

    ``tidy`` may drop rows of a chunk, which come in ``order``. A chunk's rows are
    gathered in one task; the number of values of ``c`` must follow the input.
    """
    spark = rows.sparkSession
    n = min(int(spark.conf.get(f"spark.sql.{x}")) for x in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    fields = [f for f in rows.schema.fields if f.name != "c"]
    schema = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("rows", T.ArrayType(T.StructType(fields)))])

    def pack(batches):
        names = [f.name for f in fields]
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            c = table.column("c")[0].as_py()
            table = table.select(names) if tidy is None else tidy(table.select(names))
            struct = pa.StructArray.from_arrays([x.combine_chunks() if x.num_chunks != 1 else x.chunk(0) for x in table.columns], names)
            return pa.record_batch([pa.array([c], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)], ["c", "rows"])

        for batch in batches:
            c = batch.column("c").to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi > lo:
                    if held and held[0].column("c")[0].as_py() != c[lo]:
                        yield flush()
                        held.clear()
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush()

    packed = rows.repartition(n, "c").sortWithinPartitions("c", *order).mapInArrow(pack, schema)
    name, path = f"{TABLES}{uuid.uuid4().hex}", f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    note_written(path, name)
    packed.write.bucketBy(n, "c").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def chunk_rows(batches) -> Iterator[tuple[int, list[pa.Array], list[pa.Array]]]:
    """(c, columns of its rows, the other columns' values) for each chunk of a batch."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), batch.column(1)[k].values.flatten(), [x[k].as_py() for x in batch.columns[2:]]


ASKS = "slice int, c int, names binary, more binary, many binary"


def asks(c: int, names: np.ndarray, many: np.ndarray, bits: int, width: int = 8, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``ASKS`` from a chunk's sorted names; ``many`` marks those that need no other chunk.

    ``width`` is 8, or 4 for names cut to ``bits`` + 32 bits; ``more`` are 32 more bits of each.
    """
    owner = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    short = names if width == 8 else (names >> np.uint64(32 - bits)).astype(np.uint32)
    edge = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    out: list[list] = [[], [], [], []]
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        out[0].append(int(owner[lo]))
        out[1].append(short[lo:hi].tobytes())
        out[2].append(None if more is None else more[lo:hi].tobytes())
        out[3].append(np.packbits(many[lo:hi]).tobytes() if many[lo:hi].any() else None)
    n = len(out[0])
    return pa.record_batch([pa.array(out[0], pa.int32()), pa.array([c] * n, pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["slice", "c", "names", "more", "many"])


def cut_names(names: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits`` + 32 bits."""
    drop = np.uint64(max(0, 32 - bits))
    return names >> drop << drop


def answered(asked: DataFrame, find: Find, width: int = 8) -> DataFrame:
    """(c, parts): for each chunk, the slices with a name that ``find`` marks, and their bits."""

    def run(key, table):
        names = [np.frombuffer(x, np.uint64 if width == 8 else np.uint32) for x in table.column("names").to_pylist()]
        more = [None if x is None else np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()]
        many = [np.zeros(len(n), bool) if x is None else np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) > 0 for n, x in zip(names, table.column("many").to_pylist(), strict=True)]
        marks = find(names, more, many)
        keep = pa.array([bool(x.any()) for x in marks])
        bits = pa.array([np.packbits(x).tobytes() for x in marks], pa.binary())
        slices = pa.array([key[0].as_py()] * len(marks), pa.int32())
        return pa.table({"c": table.column("c").combine_chunks().filter(keep), "slice": slices.filter(keep), "bits": bits.filter(keep)})

    found = asked.groupBy("slice").applyInArrow(run, "c int, slice int, bits binary")
    return found.groupBy("c").agg(F.collect_list(F.struct("slice", "bits")).alias("parts"))


def met_twice(names: list[np.ndarray], more: list[np.ndarray | None], many: list[np.ndarray]) -> list[np.ndarray]:
    """The slice sorted: names beside an equal one, or marked."""
    every, flags = np.concatenate(names), np.concatenate(many)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = s[1:] == s[:-1]
    if more[0] is not None:
        rank = np.concatenate(more)
        tie = rank[order][1:] == rank[order][:-1]
        if (same & ~tie).any():
            order = np.lexsort((rank, every))
            s = every[order]
            same, tie = s[1:] == s[:-1], rank[order][1:] == rank[order][:-1]
        same &= tie
    twice = flags[order]
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(every), bool)
    out[order] = twice
    return np.split(out, np.cumsum([len(x) for x in names])[:-1])


def lookup(names: np.ndarray, parts, bits: int) -> np.ndarray:
    """Which of a chunk's sorted names the slices have marked."""
    out = np.zeros(len(names), bool)
    if not parts:
        return out
    owner = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    for part in parts:
        lo, hi = np.searchsorted(owner, [part["slice"], part["slice"] + 1])
        out[lo:hi] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=int(hi - lo)) > 0
    return out
