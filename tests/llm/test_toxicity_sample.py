"""The sample that the toxicity model learns from: its bound, repeated ids, and ids that are texts."""

from pyspark.sql import functions as F

from tessera.llm import toxicity


def test_repeated_ids_are_one_row(spark):
    docs = spark.range(500).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(6, "other"), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate((5, 5, 6, 8, 9, 11))], "doc_id long, toxic int")
    assert toxicity._labelled(docs, labels, "doc_id", "text", 1).count() <= 1
    rows = toxicity._labelled(docs, labels, "doc_id", "text", 100).collect()
    assert len(rows) == len({r["text"] for r in rows}) <= 3
    assert {r["text"] for r in rows} <= {"text 0", "other", ""}


def test_text_ids(spark):
    docs = spark.createDataFrame([(f"d{k}", ("vile " if k % 4 == 0 else "mild ") + f"w{k % 7} " * 5) for k in range(400)], "doc_id string, text string")
    labels = docs.select("doc_id", F.expr("cast(text like 'vile%' as int)").alias("toxic"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 400 and all((r["score"] >= 0.7) == (r["toxic"] == 1) for r in got)
    mixed = labels.select(F.regexp_replace("doc_id", "d", "").cast("long").alias("doc_id"), "toxic")
    assert toxicity.score(docs.withColumn("doc_id", F.regexp_replace("doc_id", "d", "")), mixed).count() == 400
