"""Registry of queries: a name, a plan over the tables of a folder, and SQL for it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import points_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` gives the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query exists: {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Points of the embeddings; those with label 3 are selected."""
    points = points_of(read(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    return points.withColumn("flags", F.when(F.col("label") == 3, 1).otherwise(0))


def layout(spark: SparkSession, folder: str) -> DataFrame:
    """id, x, y, label, flags: the first two dimensions as a drawing."""
    return panel(spark, folder).select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"), "label", "flags")


def drawing(spark: SparkSession, folder: str) -> DataFrame:
    """id, y: a fixed two-dimensional embedding by sine and cosine of the id."""
    return panel(spark, folder).select("id", F.array(F.sin(F.col("id") * 1.7) * 2, F.cos(F.col("id") * 0.9) * 3).alias("y"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits) + F.lit(0.0))
    return df


def rounded_pairs(df: DataFrame, column: str, digits: int) -> DataFrame:
    """:func:`rounded` of numbers that are not negative, without a decimal for each row: for results of very many rows."""
    scale = 10.0**digits
    return df.withColumn(column, F.floor(F.col(column) * scale + 0.5) / F.lit(scale))


#: SQL of the shared inputs.
PTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings)"
CELLS = "cells AS (SELECT vec_id AS id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
DRAWING = "drawing AS (SELECT vec_id AS id, sin(vec_id * 1.7) * 2 AS y0, cos(vec_id * 0.9) * 3 AS y1 FROM embeddings)"


def knn_sql(k: int, name: str = "knn", where: str = "") -> str:
    """k nearest of the points of PTS."""
    return f"""{name} AS (SELECT i, j, rk, d2 FROM (SELECT a.id AS i, b.id AS j, pow(list_distance(a.f, b.f), 2) AS d2,
      row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rk FROM pts a JOIN pts b ON a.id <> b.id {where}) WHERE rk <= {k})"""


def edges_sql(k: int = 5) -> str:
    """edges: k nearest with w = 1 / (1 + d2)."""
    return f"{PTS}, {knn_sql(k)}, edges AS (SELECT i, j, 1.0 / (1.0 + d2) AS w FROM knn)"


def edges(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    from ..operators.knn import knn

    return knn(panel(spark, folder), k).select("i", "j", (1.0 / (1.0 + F.col("d2"))).alias("w"))


def transition(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    from ..operators.similarity import row_normalised

    return row_normalised(edges(spark, folder, k))


def transition_sql(k: int = 5) -> str:
    return f"{edges_sql(k)}, t AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM edges)"
