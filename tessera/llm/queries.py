"""The subpackage's registered queries: op1 to op13."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, langid, lines, mixing, neardup, periodic, quality, repeats, resample, tokens, toxicity, urls
from ._spark import note_written, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(_read(spark, sf_dir, "documents"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files lie below the shared folder, and go with ``sweep``."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    note_written(path)
    return tokens.digest(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_minhash_neardup": op4_minhash_neardup,
    "op5_decontamination": op5_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_importance": op11_importance,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_ids": op13_token_ids,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": lines.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_importance": resample.ORACLE,
}
