"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) from (a, b): the least node of each component, for its nodes.

    A round gives each node the least label among its neighbours and that of its own
    label, which is a node too, in one join and one aggregation; labels jump along, so
    that the rounds grow with the logarithm of the longest path. Labels are written to
    the shared folder after each round, and one sum goes to the driver: labels only
    fall, so an equal sum ends the loop. Nodes without an edge do not occur.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), narrow=True)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), narrow=True)
    before = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        reach = both.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        near = reach.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("label"))
        labels = cut(near.withColumnRenamed("a", "node"), narrow=True)
