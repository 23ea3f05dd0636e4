"""The streamed change feed against the batch feed: ties, restarts, growth, and groups that are not read."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.sources.tables import books
from tessera.streaming.change_feed import ChangeReader, change_feed


def drain(spark, folder, table, **options):
    feed = change_feed(spark, table, **options)
    q = feed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [x["numInputRows"] for x in q.recentProgress if x["numInputRows"]]


def given(spark, folder):
    return sorted((r["updated_at"], r["id"], r["cents"]) for r in spark.read.parquet(f"{folder}/out").collect())


@pytest.fixture
def table(spark, sf):
    return books(spark, sf).select("id", "cents", F.col("updated_at").cast("timestamp").alias("updated_at"))


def test_restart_gives_the_batch_feed_once(spark, table, tmp_path):
    """Rows of the same days come in three parts; each start goes on from the checkpoint."""
    folder, path = str(tmp_path), f"{tmp_path}/table"
    last = table.agg(F.max("updated_at")).first()[0]
    tied = table.withColumn("updated_at", F.when(F.col("id") % 5 == 0, F.lit(last)).otherwise(F.col("updated_at")))
    late = (F.col("updated_at") == last) & (F.col("id") >= 300)
    tied.filter(~late).repartition(3).write.parquet(path)
    first = drain(spark, folder, path)
    # more rows of the very last time, with greater ids: after the offset, though not after its time
    tied.filter(late).coalesce(1).write.mode("append").parquet(path)
    second = drain(spark, folder, path)
    assert drain(spark, folder, path) == []
    want = sorted((r["updated_at"], r["id"], r["cents"]) for r in tied.collect())
    assert given(spark, folder) == want and sum(first) + sum(second) == len(want)
    assert sync.change_feed(spark.read.parquet(path), None).count() == len(want)


def test_spans_end_between_ties(spark, tmp_path):
    """Any two offsets, also between rows of one time: what lies between them comes once, and rows without a time or id never."""
    rows = [(k, k, f"2024-01-0{1 + k // 40}") for k in range(100)] + [(200, 0, None), (None, 0, "2024-01-01")]
    df = spark.createDataFrame(rows, "id long, cents int, at string").select("id", "cents", F.to_timestamp("at").alias("updated_at"))
    df.repartition(4).write.parquet(f"{tmp_path}/table")
    reader = ChangeReader({"path": f"{tmp_path}/table"}, pa.schema([("id", pa.int64())]))
    last = reader.latestOffset()
    day = 86_400_000_000
    ends = [{"at": last["at"] - 2 * day, "id": 7}, {"at": last["at"] - 2 * day, "id": 39}, {"at": last["at"] - day, "id": 55}, last]
    start, seen = reader.initialOffset(), []
    for end in ends:
        seen.append(sorted(i for p in reader.partitions(start, end) for b in reader.read(p) for i in b.column("id").to_pylist()))
        start = end
    assert [len(x) for x in seen] == [8, 32, 16, 44] and sum(seen, []) == list(range(100))
    assert not [i for p in reader.partitions(last, last) for b in reader.read(p) for i in b.column("id").to_pylist()]


def test_an_update_comes_again_with_its_new_time(spark, tmp_path):
    path = f"{tmp_path}/table"
    make = lambda rows: spark.createDataFrame(rows, "id string, cents int, at string").select("id", "cents", F.to_timestamp("at").alias("updated_at"))
    make([("a", 1, "2024-01-01"), ("b", 1, "2024-01-02")]).coalesce(1).write.parquet(path)
    drain(spark, str(tmp_path), path)
    make([("a", 2, "2024-01-03"), ("b", 1, "2024-01-02")]).coalesce(1).write.mode("overwrite").parquet(path)
    drain(spark, str(tmp_path), path)
    assert [(i, c) for _, i, c in given(spark, str(tmp_path))] == [("a", 1), ("b", 1), ("a", 2)]


def test_groups_outside_the_span_are_not_read(spark, tmp_path):
    df = spark.range(1000).select("id", F.lit(0).alias("cents"), F.timestamp_seconds(F.col("id") * 60).alias("updated_at"))
    pq.write_table(df.orderBy("id").toArrow(), f"{tmp_path}/t.parquet", row_group_size=100)
    reader = ChangeReader({"path": f"{tmp_path}/t.parquet"}, pa.schema([("id", pa.int64())]))
    end = reader.latestOffset()
    assert end == {"at": 999 * 60_000_000, "id": 999}
    parts = reader.partitions({"at": 850 * 60_000_000, "id": 850}, end)
    assert [p.group for p in parts] == [8, 9]
    assert sum(len(b) for p in parts for b in reader.read(p)) == 149


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "id long, cents int, updated_at timestamp").write.parquet(f"{tmp_path}/t")
    assert drain(spark, str(tmp_path), f"{tmp_path}/t") == []
