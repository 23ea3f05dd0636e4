"""Price catalogues: files, longest-prefix lookup, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models

PRICE_FILE = "map<string, struct<mode: string, input_cost_per_token: double, output_cost_per_token: double, supports_vision: boolean>>"


def price_file(raw: DataFrame, column: str = "json") -> DataFrame:
    """model, input, output (dollars a million tokens), vision: chat models with sound prices.

    A provider prefix up to the first slash is taken off.
    """
    rows = raw.select(F.explode(F.from_json(column, PRICE_FILE)).alias("key", "v"))
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    rows = rows.filter(F.col("v.mode") == "chat").filter(ok("v.input_cost_per_token") & ok("v.output_cost_per_token"))
    million = lambda c: (F.floor(F.col(c) * 1e6 * 1e6 + 0.5) / 1e6)
    return rows.select(F.regexp_replace("key", "^[^/]*/", "").alias("model"), million("v.input_cost_per_token").alias("input"), million("v.output_cost_per_token").alias("output"), F.col("v.supports_vision").alias("vision"))


def longest_prefix(ids: DataFrame, table: DataFrame, id_col: str, key: str, boundary: str | None = "[-@]") -> DataFrame:
    """Each id with the row of the longest key that it starts with.

    Every prefix of an id that may be a key is exploded and met by an equi join, so
    neither side is compared row by row. With a ``boundary``, the character after the
    key must match it; an exact match always counts.
    """
    n = F.length(id_col)
    cut = F.sequence(F.lit(1), n)
    after = lambda i: F.substring(F.col(id_col), i + 1, F.lit(1))
    if boundary:
        cut = F.filter(cut, lambda i: (i == n) | after(i).rlike(f"^{boundary}"))
    wide = ids.select(id_col).distinct().filter(n > 0).withColumn("__n", F.explode(cut)).withColumn("__p", F.substring(F.col(id_col), F.lit(1), F.col("__n")))
    met = wide.join(table, F.col("__p") == F.col(key))
    best = met.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("__n")))).filter("__r = 1").drop("__r", "__n", "__p")
    return ids.join(best, id_col, "left")


def rank(models_: DataFrame, preferred: Sequence[str] = (), native: bool = True, limit: int = 100) -> DataFrame:
    """rank, provider, model from (provider, model, input, output): preferred ones in their order, then cheap, stable, new."""
    m = models_.dropDuplicates(["model"]).filter(models.is_text_model(F.col("provider"), F.col("model")))
    pref = F.array_position(F.array(*map(F.lit, preferred)), F.col("model")) if preferred else F.lit(0)
    place = F.when(pref > 0, pref).otherwise(1_000_000)
    demoted = F.lit(False) if native else F.col("model").rlike(models.DEMOTED)
    order = [place, demoted, F.col("input") * 0.75 + F.col("output") * 0.25, F.col("model").rlike(models.UNSTABLE), models.version_of(F.col("model")).desc(), F.collate("model", "UNICODE")]
    top = m.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "provider", "model")
