"""Versioned snapshots of a table that is read anew now and then, such as prices.

A folder holds

- ``data/<version>``: Parquet, written whole before anything points to it;
- ``versions/<version>``: an empty file; the greatest number is the current version.
  It is created only if nobody has created it before, so of two writers that race for
  a number one goes on with the next, and no store need rename;
- ``batches/<query>/<batch>/<version>``: an empty file, the version that a streaming
  batch has used, so that a batch that is repeated after a crash uses the same one.

A new version counts only if it holds ``least`` rows: a truncated or wrong file leaves
the one before where it is, a copy and not what lies at the source by now.

Cases: without any version that was large enough there is no snapshot (None); a source
that cannot be read counts as too small; rows go in as they come, duplicates and nulls
included; a folder that does not exist has no version.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

LEAST = 50
DAY_MS = 86_400_000


class Snapshots:
    """The versions in one folder of any store that Hadoop reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[tuple[str, int]]:
        """Names below a folder and when each was written."""
        path, fs = self._at(*parts)
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(path)] if fs.exists(path) else []

    def _create(self, *parts: str) -> bool:
        """Create an empty file; False if it is there already."""
        path, fs = self._at(*parts)
        try:
            fs.create(path, False).close()
        except Py4JJavaError:
            if fs.exists(path):
                return False
            raise
        return True

    def versions(self) -> list[int]:
        return sorted(int(name) for name, _ in self._names("versions"))

    def frame(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data/{version:012}")

    def current(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self) -> DataFrame | None:
        """The current snapshot."""
        version = self.current()
        return None if version is None else self.frame(version)

    def age_ms(self, now_ms: int | None = None) -> int | None:
        """Since the current version was pointed to."""
        newest = max(self._names("versions"), default=None)
        return None if newest is None else (int(time.time() * 1000) if now_ms is None else now_ms) - newest[1]

    def publish(self, frame: DataFrame, least: int = LEAST) -> int | None:
        """Write a version and point to it, if it holds enough rows; else None, and nothing has changed."""
        taken = [int(name) for name, _ in self._names("data")]
        version = max(taken, default=0) + 1
        while True:
            path, fs = self._at("data", f"{version:012}")
            frame.write.mode("errorifexists").parquet(str(path))
            if self.frame(version).limit(least).count() < least:
                fs.delete(path, True)
                return None
            if self._create("versions", f"{version:012}"):
                return version
            version = max(self.versions()) + 1

    def refresh(self, main: Callable[[], DataFrame], others: dict[str, Callable[[], DataFrame]] | None = None, least: int = LEAST, source: str = "source") -> bool:
        """Read all sources and publish them as one version; True if it counts.

        ``main`` must give ``least`` rows. Another one that fails or is empty leaves the rows
        that the current version has of it; ``source`` is the column that names it.
        """
        try:
            frame = main()
            if frame.limit(least).count() < least:
                return False
        except (PySparkException, Py4JJavaError):
            return False
        before = self.read()
        for name, get in (others or {}).items():
            try:
                part = get()
                fine = not part.isEmpty()
            except (PySparkException, Py4JJavaError):
                fine = False
            if not fine:
                part = None if before is None else before.filter(before[source] == name)
            frame = frame if part is None else frame.unionByName(part.select(frame.columns))
        return self.publish(frame, least) is not None

    def refresh_if_stale(self, main: Callable[[], DataFrame], others: dict[str, Callable[[], DataFrame]] | None = None, least: int = LEAST, max_age_ms: int = DAY_MS, now_ms: int | None = None) -> bool:
        """Refresh only where there is no version or it is old."""
        age = self.age_ms(now_ms)
        return True if age is not None and age < max_age_ms else self.refresh(main, others, least)

    def pinned(self, query: str, batch_id: int) -> int | None:
        """The version of a batch: that of its first try, or the current one from now on."""
        found = [int(name) for name, _ in self._names("batches", query, str(batch_id))]
        if not found:
            version = self.current()
            if version is None:
                return None
            self._create("batches", query, str(batch_id), f"{version:012}")
            found = [version]
        return min(found)

    def prune(self, keep: int = 3) -> list[int]:
        """Delete all but the newest versions and those of each query's last batch; returns what went."""
        held = set(self.versions()[-keep:])
        for query, _ in self._names("batches"):
            last = max((int(name) for name, _ in self._names("batches", query)), default=None)
            held |= {int(name) for name, _ in self._names("batches", query, str(last))} if last is not None else set()
        gone = [v for v in self.versions() if v not in held]
        for v in gone:
            for part in ("versions", "data"):
                path, fs = self._at(part, f"{v:012}")
                fs.delete(path, True)
        return gone


def with_versions(events: DataFrame, snapshots: Snapshots, read: Callable[[], DataFrame], use: Callable[[DataFrame, DataFrame | None, int], None], query: str, least: int = LEAST, max_age_ms: int = 0) -> DataStreamWriter:
    """Batches of ``events`` with a snapshot of a table each.

    Before a batch is tried first, the table is read anew if the current version is
    older than ``max_age_ms``; what ``use`` gets is the stored version that the batch is
    pinned to, or None as long as there is none.
    """

    def batch(frame: DataFrame, batch_id: int) -> None:
        if not snapshots._names("batches", query, str(batch_id)):
            snapshots.refresh_if_stale(read, None, least, max_age_ms)
        version = snapshots.pinned(query, batch_id)
        use(frame, None if version is None else snapshots.frame(version), batch_id)

    return events.writeStream.foreachBatch(batch)
