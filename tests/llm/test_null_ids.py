"""Benchmark items without an id."""

from tessera.llm import decontam


def test_items_without_an_id_are_searched(spark):
    first, second = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    docs = spark.createDataFrame([(1, f"x y z {first}"), (2, f"{second} u v"), (3, "clean text of six plain words")], "doc_id long, text string")
    items = spark.createDataFrame([(None, first), (7, second), (8, None), (None, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == {(1, None), (2, 7)}
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [3]
