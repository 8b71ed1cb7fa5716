"""Shapes of the tables that the operators exchange, and checks of them.

points      id, features (array of double), flags, any payload columns
cells       id, dim, x                      long form of points
embedding   id, y (array of double)
edges       i, j, w                         sparse matrix, weighted graph
knn         i, j, rk, d2
sets        id, members (array of long)     membership: a, b in long form
landmarks   scale, lm, orig_id, prev_id, weight
transition  scale, i, j, p
aoi         scale, prev, lm, p
clusters    scale, cluster_id, parent_id, notes
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of ``flags``.
NONE, SELECTED, FIXED, DISABLED = 0, 1, 2, 4


def is_set(flags: Column, bit: int = SELECTED) -> Column:
    return flags.bitwiseAND(bit) == bit


def with_width(points: DataFrame, width: int, features: str = "features") -> DataFrame:
    """``points``, failing at run time on a row of another width."""
    right = F.size(features) == width
    return points.withColumn(features, F.when(right, F.col(features)).otherwise(F.raise_error(F.concat(F.lit(f"width is not {width} but "), F.size(features).cast("string")))))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def points_of(df: DataFrame, id_col: str, features_col: str, *more: str) -> DataFrame:
    """Points in double precision, none selected."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features_col).cast("array<double>").alias("features"), F.lit(NONE).alias("flags"), *more)


def to_cells(points: DataFrame, *keep: str) -> DataFrame:
    return points.select("id", *keep, F.posexplode("features").alias("dim", "x"))


def from_cells(cells: DataFrame) -> DataFrame:
    """Points again; dimensions in order."""
    return cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("features"))
