"""Conditional and joint probabilities of neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calibrate
from . import knn as nn

#: Cells of a distance matrix that a task fits at once.
ROW_CELLS = 1 << 20


@dataclass(frozen=True)
class Parameters:
    """Of the neighbourhood graph: ``perplexity * multiplier`` neighbours."""

    perplexity: float = 30.0
    multiplier: int = 3
    steps: int = calibrate.STEPS
    tolerance: float = calibrate.TOLERANCE

    @property
    def neighbours(self) -> int:
        return int(self.perplexity * self.multiplier)


def calibrated(graph: DataFrame, target: float, *, by_weight: bool = False, method: str = "kernel", steps: int = calibrate.STEPS, tolerance: float = calibrate.TOLERANCE) -> DataFrame:
    """i, j, w, sigma: rows of a graph (i, j, d2) as distributions of a given perplexity (or kernel sum).

    Neighbours of a point are gathered to one row (a graph has a bounded number
    of them) and fitted by the numpy kernel, or by a Column expression.
    """
    rows = graph.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d2", "j"))).alias("n"))
    rows = rows.select("i", F.transform("n", lambda n: n["j"]).alias("j"), F.transform("n", lambda n: n["d2"]).alias("d"))
    if method == "column":
        fitted = rows.withColumn("fit", calibrate.beta(F.col("d"), target, by_weight=by_weight, steps=steps, tolerance=tolerance)).withColumn("p", calibrate.probabilities(F.col("d"), F.col("fit"))).withColumn("sigma", F.when(F.col("fit.found"), calibrate.sigma(F.col("fit"))).otherwise(1.0))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("d")
                n = np.diff(lists.offsets.to_numpy())
                valid = np.arange(n.max())[None] < n[:, None]
                d = np.zeros(valid.shape)
                d[valid] = lists.flatten().to_numpy()
                p, s = calibrate.kernel(d, target, valid=valid, by_weight=by_weight, steps=steps, tolerance=tolerance)
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(p[valid]))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), out, pa.array(s)], names=["i", "j", "p", "sigma"])

        fitted = rows.mapInArrow(run, "i long, j array<long>, p array<double>, sigma double")
    return fitted.select("i", F.explode(F.arrays_zip("j", "p")).alias("e"), "sigma").select("i", F.col("e.j").alias("j"), F.col("e.p").alias("w"), "sigma")


def conditional(points: DataFrame, parameters: Parameters = Parameters(), method: str = "kernel") -> DataFrame:
    """i, j, w: each point's distribution over its nearest neighbours, by squared distances."""
    graph = nn.knn(points, parameters.neighbours)
    return calibrated(graph, parameters.perplexity, method=method, steps=parameters.steps, tolerance=parameters.tolerance).select("i", "j", "w")


def symmetrised(edges: DataFrame) -> DataFrame:
    """(w_ij + w_ji) / 2, where a missing side is 0."""
    both = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))


def joint(points: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """Symmetrised conditional probabilities; the sum is the number of points."""
    return symmetrised(conditional(points, parameters))


def from_distance_matrix(distances: DataFrame, perplexity: float) -> DataFrame:
    """i, j, w from all squared distances (i, j, d2); the diagonal is kept as 0."""
    fitted = calibrated(distances.filter("i <> j"), perplexity).select("i", "j", "w")
    return fitted.unionByName(distances.filter("i = j").select("i", "j", F.lit(0.0).alias("w")))


def from_points(points: DataFrame, perplexity: float) -> DataFrame:
    """:func:`from_distance_matrix` of the squared distances of all points (id, features).

    Tasks hold all points (MOST_CELLS), make whole rows of the matrix and fit them,
    so its cells are not gathered by a shuffle. More points, or ids that occur
    twice, go by cells.
    """
    given = points.select("id", "features").filter("features IS NOT NULL")
    own = points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d2"))
    table = nn.fetched(given)
    if table is None or len(np.unique(ids := table.column("id").to_numpy())) < table.num_rows:
        return from_distance_matrix(nn.all_distances(points).unionByName(own), perplexity)
    every = points.sparkSession.sparkContext.broadcast((ids, nn._matrix(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, b = every.value
        step = max(1, ROW_CELLS // max(1, len(ids)))
        for batch in batches:
            for s in range(0, batch.num_rows if len(ids) > 1 else 0, step):
                part = batch.slice(s, step)
                mine, others = part.column("id").to_numpy(), part.column("id").to_numpy()[:, None] != ids
                d = nn._apart(nn._matrix(part), b, "l2sq")[others].reshape(len(mine), -1)
                p, _ = calibrate.kernel(d, perplexity)
                j = np.broadcast_to(ids, others.shape)[others]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, d.shape[1])), pa.array(j), pa.array(p.reshape(-1))], names=["i", "j", "w"])

    return given.mapInArrow(run, "i long, j long, w double").unionByName(own.select("i", "j", F.lit(0.0).alias("w")))


def row_normalised(edges: DataFrame) -> DataFrame:
    """Rows sum to one; a row whose weights are all zero stays so."""
    total = F.sum("w").over(Window.partitionBy("i"))
    return edges.withColumn("w", F.when(total == 0, 0.0).otherwise(F.col("w") / total))


def column_normalised(edges: DataFrame) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy("j"))
    return edges.withColumn("w", F.when(total == 0, 0.0).otherwise(F.col("w") / total))


def row_cdf(edges: DataFrame) -> DataFrame:
    """i, j, w, lo, hi: the share of the row's mass before and up to each entry, by j; the last one closes at 1."""
    order = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("i")
    edges = edges.withColumn("__total", F.sum("w").over(last)).filter(F.col("__total") > 0)
    run = edges.withColumn("hi", F.sum("w").over(order) / F.col("__total"))
    run = run.withColumn("lo", F.lag("hi", 1, 0.0).over(Window.partitionBy("i").orderBy("j")))
    return run.withColumn("hi", F.when(F.col("j") == F.max("j").over(last), 1.0).otherwise(F.col("hi"))).select("i", "j", "w", "lo", "hi")


def walk_weights(points: DataFrame, k: int = 30) -> DataFrame:
    """Edges of the random-walk graph: exp(-x^2) of squared distances over twice their deviation in the row, normalised."""
    row = Window.partitionBy("i")
    graph = nn.knn(points, k).withColumn("s", F.stddev_pop("d2").over(row))
    x = F.col("d2") / F.when(F.col("s") == 0, 1.0).otherwise(2 * F.col("s"))
    return row_normalised(graph.select("i", "j", F.exp(-x * x).alias("w")))


def hsne_graph(points: DataFrame, k: int = 30) -> DataFrame:
    """First-scale transition matrix: k neighbours at perplexity k/3; rows sum to 1."""
    return calibrated(nn.knn(points, k), k / 3).select("i", "j", "w")


def top_transitions(edges: DataFrame, n: int) -> DataFrame:
    """Rows re-calibrated from transition probabilities: perplexity n/20 over its threefold best entries, at distance 1 - p."""
    target = max(1.5, n / 20)
    best = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    kept = edges.withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= int(3 * target))
    return calibrated(kept.select("i", "j", (1 - F.col("w")).alias("d2")), target).select("i", "j", "w")
