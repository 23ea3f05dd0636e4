"""Streams from files of the test data against their batch twins."""

from pyspark.sql import functions as F

from tessera.operators import state
from tessera.sources.tables import books, read, usage_events
from tessera.streaming import streams

DAY = 86_400_000


def _stream(spark, df, tmp_path, parts=3):
    df.repartition(parts).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_rate_limit_twin(spark, sf, tmp_path):
    e = read(spark, sf, "events")
    source = _stream(spark, e, tmp_path, 1)
    out = streams.rate_limit_stream(source, "user_id", "ts", "event_id", 2, DAY)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["key"], r["id"], r["accepted"], r["retry_after"]) for r in spark.table("limited").collect()}
    want = {tuple(r) for r in state.rate_limit(e, "user_id", "ts", "event_id", 2, DAY).collect()}
    assert got == want


def test_daily_usage(spark, sf, tmp_path):
    u = usage_events(spark, sf)
    out = streams.daily_usage_stream(_stream(spark, u, tmp_path, 1))
    q = out.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["day"], r["calls"]) for r in spark.table("daily").collect()}
    want = {(r["day"], r["calls"]) for r in u.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls")).collect()}
    assert got and got <= want


def test_last_write_wins_sink_is_idempotent(spark, sf, tmp_path):
    b = books(spark, sf).filter("id < 500")
    changes = b.filter("id % 3 = 0").select("id", "user_id", (F.col("cents") + 1).alias("cents"), (F.col("updated_at") + F.expr("interval 1 day")).alias("updated_at"))
    states = {0: b}

    def write(df, batch_id):
        path = str(tmp_path / f"state{len(states)}")
        df.write.parquet(path)
        states[len(states)] = spark.read.parquet(path)

    for run in range(2):
        source = _stream(spark, changes, tmp_path / str(run), 1)
        q = streams.apply_changes(source, lambda: states[max(states)], write, ["cents"]).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = lambda df: sorted((r["id"], r["cents"]) for r in df.collect())
    assert len(states) == 3
    assert rows(states[1]) == rows(states[2]) != rows(b)
