"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import smallest_labels
from . import common


def connected(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every node of the edges (a, b).

    Rounds are stored tables in the shared folder; only counts and the few ids
    of hot nodes come to the driver.
    """
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = common.materialize(both.select(F.col("a").alias("i"), F.col("b").alias("j")), "edges")
    labels = common.materialize(both.groupBy(F.col("i").alias("node")).agg(F.least(F.min("j"), F.col("node")).alias("label")), "labels")
    labels = smallest_labels(both, labels, lambda df: common.materialize(df, "labels"), lambda df: common.drop_table(spark, df))
    common.drop_table(spark, both)
    return labels
