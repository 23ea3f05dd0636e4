"""Lookups over a laid-out table read few row groups, shown by the scan's own counts."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.sources.layout import rows_scanned, write_indexed
from tessera.sources.tables import books

ROWS, FILES = 200_000, 20


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ids in no order, and a hash of each."""
    path = str(tmp_path_factory.mktemp("layout") / "t")
    df = spark.range(ROWS).select((F.col("id") * 7919 % ROWS).alias("id"), F.md5(F.col("id").cast("string")).alias("hash"), F.lit("x" * 50).alias("rest"))
    write_indexed(df, path, "id", ["hash"], FILES, ndv=20_000, group_bytes=256 << 10)
    return path


def scanned(df):
    df.collect()
    return rows_scanned(df)


def test_the_filters_are_there(spark, folder):
    meta = [pq.read_metadata(f) for f in spark.read.parquet(folder).inputFiles() for f in [f.removeprefix("file://")]]
    assert len(meta) == FILES and sum(m.num_rows for m in meta) == ROWS


@pytest.mark.parametrize("key", [0, 12_345, ROWS - 1])
def test_by_the_sorted_key(spark, folder, key):
    found = spark.read.parquet(folder).filter(F.col("id") == key)
    assert [r["id"] for r in found.collect()] == [key] and scanned(found) <= 2 * ROWS / FILES


def test_by_the_other_key(spark, folder):
    """Every file's range of hashes holds the wanted one; the Bloom filters leave one file of twenty."""
    want = spark.range(1).select(F.md5(F.lit("4711"))).first()[0]
    found = spark.read.parquet(folder).filter(F.col("hash") == want)
    assert [r["hash"] for r in found.collect()] == [want] and scanned(found) <= 2 * ROWS / FILES
    gone = spark.read.parquet(folder).filter(F.col("hash") == "0" * 31 + "z")
    assert gone.collect() == [] and scanned(gone) <= ROWS / FILES


def test_several_keys(spark, folder):
    want = [r[0] for r in spark.range(3).select(F.md5((F.col("id") + 17).cast("string"))).collect()]
    found = spark.read.parquet(folder).filter(F.col("hash").isin(want))
    assert sorted(r["hash"] for r in found.collect()) == sorted(want) and scanned(found) <= 5 * ROWS / FILES


def test_without_a_layout_all_is_read(spark, tmp_path):
    df = spark.range(ROWS).select((F.col("id") * 7919 % ROWS).alias("id"), F.md5(F.col("id").cast("string")).alias("hash"))
    df.repartition(FILES).write.parquet(f"{tmp_path}/t")
    found = spark.read.parquet(f"{tmp_path}/t").filter(F.col("hash") == F.md5(F.lit("4711")))
    assert scanned(found) == ROWS


def test_lookups_of_books(spark, sf, tmp_path):
    """The lookup operators give the same rows over the layout."""
    b = books(spark, sf).withColumn("hash", F.md5(F.col("id").cast("string")))
    write_indexed(b, f"{tmp_path}/b", "id", ["hash"], 4)
    laid = spark.read.parquet(f"{tmp_path}/b")
    some = b.select("id", "hash").orderBy("id").limit(5).collect()
    assert sorted(map(tuple, laid.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    for r in some:
        assert [x["id"] for x in laid.filter(F.col("hash") == r["hash"]).collect()] == [r["id"]]
    assert rel.find_by_id(laid, some[0]["id"]).collect() == rel.find_by_id(b, some[0]["id"]).collect()


def test_empty_and_equal(spark, tmp_path):
    df = spark.createDataFrame([], "id long, hash string")
    write_indexed(df, f"{tmp_path}/e", "id", ["hash"])
    assert spark.read.schema("id long, hash string").parquet(f"{tmp_path}/e").count() == 0
    hot = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).alias("id"), F.lit("h").alias("hash"))
    write_indexed(hot, f"{tmp_path}/h", "id", ["hash"], 8)
    sizes = [pq.read_metadata(f.removeprefix("file://")).num_rows for f in spark.read.parquet(f"{tmp_path}/h").inputFiles()]
    assert sum(sizes) == 10_000 and max(sizes) < 3_000
