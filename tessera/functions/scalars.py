"""Small scalar expressions: shapes of ids, dates, JSON in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_json, strip_fences

UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def to_time(text: Column) -> Column:
    """ISO text or milliseconds since 1970 as a timestamp; null for anything else."""
    millis = text.rlike(r"\A-?\d{1,17}\z")
    return F.when(millis, F.timestamp_millis(F.when(millis, text).cast("long"))).otherwise(F.try_to_timestamp(text)).cast("timestamp_ntz")


def json_of(text: Column, schema: str) -> Column:
    """The first object in a text, fenced or not, read by a schema; null if there is none."""
    return F.from_json(first_json(strip_fences(text)), schema)


def masked(secret: Column, shown: int = 4) -> Column:
    """All but the last characters as stars."""
    n = F.greatest(F.length(secret) - shown, F.lit(0))
    return F.concat(F.repeat(F.lit("*"), n), F.right(secret, F.lit(shown)))
