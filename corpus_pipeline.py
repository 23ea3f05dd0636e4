"""The corpus pipeline: from raw documents to the training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared checkpoint folder, reads it again for the next one, and
deletes the result of the stage before and the tables that the stage wrote on its way.

Cases: all columns that come go through, whatever their names, and ``n_chars`` follows the
text where lines go. A null, empty or blank text fails the quality rules. Rows alike, and
rows with one id, are judged alike; near_dedup keeps all rows of the least id of a class,
and rows with a null id. A null source is a source of its own. An empty table, an empty
benchmark and items without a text give what is left without them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, lines, mixing, neardup, quality
from tessera.llm._spark import drop, ensure_checkpoint_dir, released

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voted rules keep; those without 20 words, and so without a text, go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the document of least id only; no document goes, though its text may become empty."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class stays; texts without a word are alone."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whether the item has an id or not."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those without a word not at all."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: SQL cannot express the estimated votes, MinHash or SimHash; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
