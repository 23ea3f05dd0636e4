"""Snapshots that stay: small files, failures, restarts, races and repeated batches."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming.snapshots import Snapshots, with_versions


def prices(spark, n, cents, source="main"):
    return spark.range(n).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"), F.lit(cents).alias("cents"), F.lit(source).alias("source"))


def cents(frame):
    return None if frame is None else sorted({r["cents"] for r in frame.collect()})


def test_small_file_leaves_the_old_prices_after_a_restart(spark, tmp_path):
    """The price file is overwritten by a small one; a new session of the code still sees the copy."""
    file = f"{tmp_path}/prices.json"
    read = lambda: spark.read.schema("model string, cents int, source string").json(file)
    prices(spark, 60, 1).write.json(file)
    assert Snapshots(spark, f"{tmp_path}/s").refresh(read)
    prices(spark, 49, 2).write.mode("overwrite").json(file)
    assert not Snapshots(spark, f"{tmp_path}/s").refresh(read)
    again = Snapshots(spark, f"{tmp_path}/s")
    assert again.current() == 1 and cents(again.read()) == [1] and again.read().count() == 60
    prices(spark, 50, 3).write.mode("overwrite").json(file)
    assert again.refresh(read) and cents(Snapshots(spark, f"{tmp_path}/s").read()) == [3]


def test_no_snapshot_yet(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/none")
    assert s.read() is None and s.age_ms() is None and s.pinned("q", 0) is None
    assert s.publish(prices(spark, 49, 1)) is None and s.versions() == []
    assert not s.refresh(lambda: spark.read.parquet(f"{tmp_path}/nowhere")) and s.read() is None


def test_a_failing_part_keeps_its_rows(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/s")
    fails = lambda: spark.read.parquet(f"{tmp_path}/nowhere")
    assert s.refresh(lambda: prices(spark, 60, 1), {"router": fails}) and s.read().count() == 60
    assert s.refresh(lambda: prices(spark, 60, 2), {"router": lambda: prices(spark, 5, 7, "router")}) and cents(s.read()) == [2, 7]
    assert s.refresh(lambda: prices(spark, 60, 3), {"router": fails}) and cents(s.read()) == [3, 7]
    assert s.refresh(lambda: prices(spark, 60, 4), {"router": lambda: prices(spark, 0, 8, "router")}) and cents(s.read()) == [4, 7]
    assert not s.refresh(fails, {"router": lambda: prices(spark, 5, 9, "router")}) and cents(s.read()) == [4, 7]


def test_stale_after_a_day(spark, tmp_path):
    s, asked = Snapshots(spark, f"{tmp_path}/s"), []
    read = lambda: asked.append(1) or prices(spark, 60, len(asked))
    assert s.refresh_if_stale(read) and len(asked) == 1
    assert s.refresh_if_stale(read) and len(asked) == 1
    later = s._names("versions")[0][1] + 86_400_000
    assert s.refresh_if_stale(read, now_ms=later - 1) and len(asked) == 1
    assert s.refresh_if_stale(read, now_ms=later) and len(asked) == 2 and cents(s.read()) == [2]


def test_two_writers(spark, tmp_path):
    """The number that one has taken meanwhile makes the other take the next."""
    s = Snapshots(spark, f"{tmp_path}/s")
    s.publish(prices(spark, 60, 1))
    other, create = Snapshots(spark, f"{tmp_path}/s"), Snapshots._create
    raced = []

    def late(*parts):
        if parts[0] == "versions" and not raced:
            raced.append(1)
            assert create(s, *parts)
        return create(other, *parts)

    other._create = late
    assert other.publish(prices(spark, 60, 2)) == 3 and cents(other.read()) == [2] and s.versions() == [1, 2, 3]


@pytest.mark.parametrize("crash", [False, True])
def test_stream_restarts(spark, tmp_path, crash):
    """A batch that failed is repeated with the version of its first try, though the prices have moved on."""
    s, now, seen = Snapshots(spark, f"{tmp_path}/s"), [60, 1], []
    broken = [crash]

    def use(frame, prices_, batch_id):
        seen.append((batch_id, frame.count(), cents(prices_)))
        if broken[0] and batch_id == 1:
            broken[0] = False
            raise RuntimeError("lost")

    def run(k):
        spark.range(k).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        q = with_versions(source, s, lambda: prices(spark, *now), use, "billing").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001
            assert crash

    run(1)
    now[:] = [60, 2]
    run(2)
    now[:] = [60, 3]
    run(3)
    now[:] = [10, 4]
    run(4)
    assert [x for x in seen if x[0] == 0] == [(0, 1, [1])]
    assert {tuple(x[2]) for x in seen if x[0] == 1} == {(2,)} and len([x for x in seen if x[0] == 1]) == 1 + crash
    assert seen[-1] == (3, 4, [3])


def test_prune_keeps_what_a_batch_may_need(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/s")
    for k in range(5):
        s.publish(prices(spark, 60, k))
        if k == 1:
            assert s.pinned("q", 0) == 2
    assert s.prune(2) == [1, 3] and s.versions() == [2, 4, 5] and cents(s.frame(2)) == [1]
    assert s.publish(prices(spark, 60, 9)) == 6 and s.pinned("q", 0) == 2
