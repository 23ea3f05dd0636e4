"""Files in any store that Hadoop reaches, and the text sink of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, url: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, url: str, content: bytes) -> None:
    """Write one object, replacing what was there."""
    path, fs = _path(spark, url)
    out = fs.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def get(spark: SparkSession, urls: str | list[str]) -> DataFrame:
    """path, length, content of objects: read by the executors, never through the driver."""
    return spark.read.format("binaryFile").load(urls).select("path", "length", "content")


def delete(spark: SparkSession, url: str) -> bool:
    path, fs = _path(spark, url)
    return fs.delete(path, True)


def exists(spark: SparkSession, url: str) -> bool:
    path, fs = _path(spark, url)
    return fs.exists(path)


def log_lines(logs: DataFrame) -> DataFrame:
    """One text line for each of ts, level, stage, message."""
    part = lambda c: F.concat(F.lit("["), F.col(c), F.lit("]"))
    when = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("]"))
    level = F.concat(F.lit("["), F.upper("level"), F.lit("]"))
    return logs.select(F.concat_ws(" ", when, level, part("stage"), F.col("message")).alias("value"))


def write_log(logs: DataFrame, url: str) -> None:
    """The lines in order of time as text files."""
    log_lines(logs.orderBy("ts", "id")).write.mode("overwrite").text(url)
