"""Price files and ranks of models on hand-made entries."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import catalog
from tessera.operators import relational as rel

PRICES = '{"a/gpt-x": {"mode": "chat", "input_cost_per_token": 0.0000025, "output_cost_per_token": 0.00001, "supports_vision": true}, "emb": {"mode": "embedding", "input_cost_per_token": 1}, "bad": {"mode": "chat", "input_cost_per_token": -1, "output_cost_per_token": 1}, "plain": {"mode": "chat", "input_cost_per_token": 0, "output_cost_per_token": 0}}'


def test_price_file(spark):
    files = spark.createDataFrame([(PRICES,), (None,), ("no json",), ("{}",)], "json string")
    assert sorted(tuple(r) for r in catalog.price_file(files).select("model", "input", "output").collect()) == [("gpt-x", 2.5, 10.0), ("plain", 0.0, 0.0)]


def test_rank(spark):
    models = [
        ("openai", "gpt-4o", 2.5, 10.0), ("openai", "gpt-4o-mini", 0.15, 0.6), ("openai", "gpt-4.1-nano", 0.1, 0.4), ("openai", "gpt-4.1-nano-preview", 0.1, 0.4),
        ("openai", "text-embedding-3-small", 0.02, 0.0), ("openai", "whisper-1", 0.0, 0.0), ("openai", "o3", 2.0, 8.0), ("openai", "gpt-5", 1.25, 10.0),
    ]
    df = spark.createDataFrame(models, "provider string, model string, input double, output double")
    order = ["gpt-4.1-nano", "gpt-4.1-nano-preview", "gpt-4o-mini", "gpt-5", "o3", "gpt-4o"]
    assert [r["model"] for r in catalog.rank(df).orderBy("rank").collect()] == order
    assert [r["model"] for r in catalog.rank(df, preferred=["o3", "gpt-4o"]).orderBy("rank").collect()][:3] == ["o3", "gpt-4o", "gpt-4.1-nano"]


def test_header_levels(spark):
    lines = ["CHAPTER 1 START", "Part II", "2.1 Title", "1.2.3 Deep", "3 Words", "AN ALL CAPITAL LINE", "IV. Roman", "plain"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(tx.header_level(F.col("line"))).collect()] == [1, 1, 2, 3, 1, 1, 2, 2]


def test_over_caps(spark):
    df = spark.range(30).select(F.when(F.col("id") < 20, "a").when(F.col("id") < 25, "b").alias("kind"))
    assert [tuple(r) for r in rel.over_caps(df, {"a": 19, "b": 5}).collect()] == [("a", 20, 19)]
    assert rel.over_caps(df, {"a": 20, "c": 0}).count() == 0
    with pytest.raises(Exception, match="too large"):
        rel.capped(df, {"a": 19}).collect()
