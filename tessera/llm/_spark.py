"""Small helpers on sessions and frames shared by the operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{ASCII_SPACE}]++"
#: names of bucketed tables begin with this
TABLES = "tessera_"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; in local mode a temporary one where it is unset."""
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tessera"


def cut(df: DataFrame, narrow: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A table is smaller than a checkpoint, has exact sizes for the planner, and does
    not carry the constraints of the plan that made it, which grow from round to
    round in a loop. ``sweep`` removes the tables. ``narrow`` is for tables that are
    small for their number of partitions: one file a core is enough.
    """
    if narrow:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    note_written(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Written(threading.local):
    """Folders and names of the tables that this thread has written so far, in order."""

    def __init__(self):
        self.tables: list[tuple[str, str | None]] = []


_written = _Written()


def note_written(path: str, table: str | None = None) -> None:
    _written.tables.append((path, table))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what this thread writes inside; for work whose result is written out by then.

    Work in other threads, such as a second pipeline, keeps its tables.
    """
    before = len(_written.tables)
    try:
        yield
    finally:
        for path, table in _written.tables[before:]:
            if table:
                spark.sql(f"drop table if exists `{table}`")
            drop(spark, path)
        del _written.tables[before:]


def drop(spark: SparkSession, url: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete what the operators have written in this session; frames made from it can't be read again.

    Results are lazy and read these tables, so only the caller knows when a result is
    done with; what is never swept ends with the checkpoint folder of the session.
    """
    for table in spark.catalog.listTables():
        if table.name.startswith(TABLES):
            spark.sql(f"drop table if exists `{table.name}`")
    drop(spark, shared_folder(spark))
    _written.tables.clear()


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Let Arrow batches of this session hold at most ``rows`` rows.

    Texts make wide rows, and a batch lies in memory on both sides of the pipe.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, rows)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; the bytes of its texts where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 60:
        return n
    texts = [F.sum(F.octet_length(f"`{c}`")) for c, kind in df.dtypes if kind == "string"]
    return sum(x or 0 for x in df.agg(*texts).first()) if texts else 0


def slices_for(df: DataFrame, bytes_each: int, least: int, most: int = 1 << 20) -> int:
    """A power of two so that each slice stands for about ``bytes_each`` of input."""
    n, total = least, input_bytes(df)
    while n < most and n * bytes_each < total:
        n *= 2
    return n


def n_words(text: str = "text"):
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
