"""The change feed as a streaming source: rows of a Parquet table in order of (time, id).

The offset is the pair (time, id) of the last row given, so rows that share a time are
neither lost nor given twice where a batch ends between them. A batch is all rows after
one offset up to another, cut into the row groups whose statistics overlap that span;
only those are read, by the executors, and only their rows in the span are given.

    spark.dataSource.register(ChangeFeed)
    spark.readStream.format("change_feed").option("path", p).option("time", "updated_at").option("id", "id").load()

Options: ``path``, a folder or file that pyarrow's file systems reach; ``time`` and ``id``,
the columns. A batch takes all there is.
The table may grow or be written anew between batches: a row that has been updated
since an offset was taken comes in a later batch, with its new time.

Cases: rows with a null time or id are in no batch; ids may be numbers or texts; rows
alike in time and id come together; rows that arrive with a time before the last offset
are never given, as with any pull by watermark; an empty table has no batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

Offset = dict[str, object]


@dataclass
class Span(InputPartition):
    """The rows of one row group after ``start`` up to ``end``."""

    file: str
    group: int
    start: Offset
    end: Offset


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def _table(self):
        from pyarrow import dataset

        return dataset.dataset(self.options["path"], format="parquet", exclude_invalid_files=False)

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._table().schema)

    def streamReader(self, schema: StructType) -> "ChangeReader":
        from pyspark.sql.pandas.types import to_arrow_schema

        return ChangeReader(self.options, to_arrow_schema(schema))


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options, schema: pa.Schema):
        self.path, self.schema = options["path"], schema
        self.time, self.id = options.get("time", "updated_at"), options.get("id", "id")

    def _files(self):
        from pyarrow import dataset

        table = dataset.dataset(self.path, format="parquet", exclude_invalid_files=False)
        return table.filesystem, sorted(table.files)

    def _span(self, meta: pq.FileMetaData, group: int) -> tuple[int, int] | None:
        """Least and greatest time of a row group, as far as its statistics tell; None if no row has a time."""
        part = meta.row_group(group)
        column = next(part.column(k) for k in range(part.num_columns) if part.column(k).path_in_schema == self.time)
        stats = None if column.physical_type == "INT96" else column.statistics  # old timestamps have none that can be read
        if stats is None or not stats.has_min_max:
            return None if stats is not None and stats.null_count == part.num_rows else (-(1 << 62), 1 << 62)
        return tuple(pa.scalar(x).cast(pa.timestamp("us")).value for x in (stats.min, stats.max))

    def _groups(self) -> Iterator[tuple[str, int, int, int]]:
        fs, files = self._files()
        for file in files:
            meta = pq.read_metadata(file, filesystem=fs)
            for k in range(meta.num_row_groups):
                span = self._span(meta, k)
                if span:
                    yield file, k, *span

    def _rows(self, file: str, group: int, start: Offset, end: Offset, names: list[str]) -> pa.Table:
        """Rows of a group in the span, with their times as microseconds in a last column."""
        fs, _ = self._files()
        table = pq.ParquetFile(file, filesystem=fs).read_row_group(group, columns=list(dict.fromkeys([*names, self.time, self.id])))
        at, i = table[self.time].cast(pa.timestamp("us")).cast(pa.int64()), table[self.id]
        keep = pc.and_(pc.is_valid(at), pc.is_valid(i))
        if start.get("at") is not None:
            keep = pc.and_(keep, pc.or_(pc.greater(at, start["at"]), pc.and_(pc.equal(at, start["at"]), pc.greater(i, pa.scalar(start["id"], i.type)))))
        if end.get("at") is not None:
            keep = pc.and_(keep, pc.or_(pc.less(at, end["at"]), pc.and_(pc.equal(at, end["at"]), pc.less_equal(i, pa.scalar(end["id"], i.type)))))
        return table.select(names).append_column("__at", at).append_column("__id", i).filter(keep)

    def initialOffset(self) -> Offset:
        return {"at": None, "id": None}

    def latestOffset(self) -> Offset:
        """The place of the last row there is.

        Groups are looked at in order of their greatest time; one that cannot change the answer is not read.
        """
        groups = sorted(self._groups(), key=lambda g: -g[3])
        best: tuple | None = None
        for file, k, _, last in groups:
            if best and last < best[0]:
                break
            rows = self._rows(file, k, {"at": best[0], "id": best[1]} if best else {}, {}, [])
            if len(rows):
                best = max(zip(rows["__at"].to_pylist(), rows["__id"].to_pylist(), strict=True))
        return {"at": best[0], "id": best[1]} if best else self.initialOffset()

    def partitions(self, start: Offset, end: Offset) -> list[Span]:
        low = start["at"] if start.get("at") is not None else -(1 << 63)
        return [Span(file, k, start, end) for file, k, first, last in self._groups() if end.get("at") is not None and first <= end["at"] and last >= low]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition.file, partition.group, partition.start, partition.end, self.schema.names)
        yield from rows.select(self.schema.names).cast(self.schema).to_batches(max_chunksize=10_000)

    def commit(self, end: Offset) -> None:
        pass


def change_feed(spark, path: str, time: str = "updated_at", id_: str = "id"):
    """The feed of a table as a streaming frame."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").option("path", path).option("time", time).option("id", id_).load()
