"""Tables laid out for lookups: sorted by one key, with Bloom filters on others.

Rows are dealt by ranges of the sort key and sorted within each file, so that a lookup by
that key meets one row group or two by their least and greatest values. A lookup
by another key, such as a hash that comes in no order, asks the Bloom filter that every
row group has of it, and reads the groups that may hold it. Both are pushed into
the scan by plain filters; the reader needs to know nothing.

Cases: nulls come first in the order and are in no filter; equal keys may span groups; a
key with more than its share of rows is split over files; an empty table is written
as one; columns of any type that Parquet filters can hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 8 << 20


def write_indexed(df: DataFrame, path: str, sort: str, lookups: Sequence[str] = (), files: int | None = None, ndv: int = 1_000_000, group_bytes: int = GROUP_BYTES) -> None:
    """Write ``df`` sorted by ``sort`` with Bloom filters on ``lookups``.

    ``files`` is the number of ranges (by default, that of shuffle partitions), ``ndv`` the
    different values that a row group is expected to hold of a lookup column at most;
    with more, the filters let more groups through. ``group_bytes`` is the size of a row group.
    """
    tie = "__tie"  # rows of one key may go to several files
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [F.col(sort), F.col(tie)]
    dealt = dealt.repartitionByRange(files, *keys) if files else dealt.repartitionByRange(*keys)
    out = dealt.sortWithinPartitions(*keys).drop(tie).write.option("parquet.block.size", group_bytes)
    for c in lookups:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", ndv)
    out.parquet(path)


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of a frame, once it has been run, gave to the rest of its plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan
    leaves, total = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        metric = leaves.apply(k).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total
