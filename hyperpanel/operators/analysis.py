"""Clustering, evaluation of embeddings, linear methods and alignment of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.vec import squared_distance
from ..schema import to_cells
from . import knn as nn
from .panel import bbox

# --- k-means ----------------------------------------------------------------


def initial_centroids(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """c, centre: random points, with replacement."""
    n = points.count()
    numbered = points.select("features", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("number"))
    draws = points.sparkSession.range(k).select(F.col("id").cast("int").alias("c"), F.pmod(rng.number(seed, F.col("id")), F.lit(n)).alias("number"))
    return numbered.join(F.broadcast(draws), "number").select("c", F.col("features").alias("centre"))  # k rows


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, c, d2: the nearest centroid, the lowest number on ties. Centroids (k rows) travel as one array."""
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("c", "centre"))).alias("all"))
    best = F.array_min(F.transform("all", lambda x: F.struct(squared_distance(F.col("features"), x["centre"]).alias("d2"), x["c"].alias("c"))))
    return points.crossJoin(F.broadcast(packed)).select("id", "features", best.alias("b")).select("id", "features", F.col("b.c").alias("c"), F.col("b.d2").alias("d2"))


def kmeans_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """c, centre after one step; a centroid without points stays."""
    cells = assign(points, centroids).select("c", F.posexplode("features").alias("dim", "x")).groupBy("c", "dim").agg(F.avg("x").alias("x"))
    moved = cells.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("new"))
    return centroids.join(moved, "c", "left").select("c", F.coalesce("new", "centre").alias("centre"))


def kmeans(points: DataFrame, k: int, iterations: int = 20, seed: int = 0) -> DataFrame:
    """Centroids; they are k rows, so each step brings them to the driver and cuts the plan."""
    spark = points.sparkSession
    centroids = initial_centroids(points, k, seed)
    for _ in range(iterations):
        rows = kmeans_step(points, centroids).collect()
        centroids = spark.createDataFrame([(r.c, r.centre) for r in rows], "c int, centre array<double>")
    return centroids


# --- evaluation -------------------------------------------------------------


def precision_recall(points: DataFrame, embedding: DataFrame, k: int, evaluated: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """k, precision, recall for 1..K: how much of each point's true neighbourhood its embedded one finds.

    mapping (id, data_id) names the point that each embedded id stands for.
    """
    shown = nn.knn(embedding.select("id", F.col("y").alias("features")), k).select("i", "j", "rk")
    if mapping is not None:
        a, b = mapping.select(F.col("id").alias("i"), F.col("data_id").alias("di")), mapping.select(F.col("id").alias("j"), F.col("data_id").alias("dj"))
        shown = shown.join(a, "i").join(b, "j").select(F.col("di").alias("i"), F.col("dj").alias("j"), "rk")
    true = nn.knn(points, k).select("i", "j", F.lit(1).alias("hit"))
    if evaluated is not None:
        shown = shown.join(evaluated.select(F.col("id").alias("i")), "i", "left_semi")
    order = Window.partitionBy("i").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    hits = shown.join(true, ["i", "j"], "left").select("i", "rk", F.sum(F.coalesce("hit", F.lit(0))).over(order).alias("hits"))
    return hits.groupBy(F.col("rk").alias("k")).agg(F.avg(F.col("hits") / F.col("rk")).alias("precision"), F.avg(F.col("hits") / float(k)).alias("recall"))


# --- linear methods ---------------------------------------------------------


def covariance(points: DataFrame, weight: str | None = None) -> DataFrame:
    """a, b, c: population covariance of dimensions, weighted by the column ``weight``; none without points or weight.

    Two passes, which also far from zero lose no digits: means, then products of
    what is left around them. Each task adds up its points first, so dimensions
    squared numbers a task are moved, whatever the number of points.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = points.filter("features IS NOT NULL").select("features", w.alias("w")).filter("w IS NOT NULL")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, mass = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                own = batch.column("w").to_numpy()
                sums, mass = sums + own @ nn._matrix(batch), mass + own.sum()
        sums = np.atleast_1d(sums) if mass else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.full(len(sums), mass))], names=["dim", "x", "w"])

    found = rows.mapInArrow(total, "dim long, x double, w double").groupBy("dim").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).orderBy("dim").collect()  # a row a dimension
    if not found or not found[0].w:
        return points.sparkSession.createDataFrame([], "a int, b int, c double")
    mean, mass = np.array([r.x / r.w for r in found]), found[0].w

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rest = np.zeros((len(mean), len(mean))), np.zeros(len(mean))
        for batch in batches:
            if batch.num_rows:
                gap, own = nn._matrix(batch) - mean, batch.column("w").to_numpy()
                both += (gap * own[:, None]).T @ gap
                rest += own @ gap
        a, b = np.indices(both.shape, np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(both.reshape(-1)), pa.array(rest[a]), pa.array(rest[b])], names=["a", "b", "ab", "ra", "rb"])

    sums = rows.mapInArrow(products, "a int, b int, ab double, ra double, rb double").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("ab", "ra", "rb")))
    return sums.select("a", "b", (F.col("ab") / mass - F.col("ra") / mass * (F.col("rb") / mass)).alias("c"))


def _neighbourhoods(points: DataFrame, edges: DataFrame) -> DataFrame:
    """i, w, x: weights and features of the neighbours of each i (edges i, j, w), features one after the other."""
    near = edges.join(points.select(F.col("id").alias("j"), "features"), "j")
    lists = near.groupBy("i").agg(F.collect_list(F.struct("w", "features")).alias("n"))
    return lists.select("i", F.transform("n", lambda n: n["w"]).alias("w"), F.flatten(F.transform("n", lambda n: n["features"])).alias("x"))


def _centred(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, shares of weight, features less their weighted mean) of each neighbourhood."""
    w, x = batch.column("w"), batch.column("x")
    weights, values = w.flatten().to_numpy(), x.flatten().to_numpy()
    wo, xo = (v.offsets.to_numpy() - v.offsets[0].as_py() for v in (w, x))
    for r, i in enumerate(batch.column("i").to_pylist()):
        share = weights[wo[r] : wo[r + 1]]
        share = share / share.sum()
        rows = values[xo[r] : xo[r + 1]].reshape(len(share), -1)
        yield i, share, rows - share @ rows


def local_covariance(points: DataFrame, edges: DataFrame) -> DataFrame:
    """i, a, b, c: weighted covariance of the neighbourhood of each i (edges i, j, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, share, gap in _centred(batch):
                c = (gap * share[:, None]).T @ gap
                a, b = np.indices(c.shape, np.int32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(c.size, i)), pa.array(a), pa.array(b), pa.array(c.reshape(-1))], names=["i", "a", "b", "c"])

    return _neighbourhoods(points, edges).mapInArrow(run, "i long, a int, b int, c double")


def _square(rows: list) -> np.ndarray:
    size = max(r.a for r in rows) + 1
    out = np.zeros((size, size))
    for r in rows:
        out[r.a, r.b] = r.c
    return out


def pca(points: DataFrame, weight: str | None = None) -> DataFrame:
    """axis, variance, direction: eigenvectors of the covariance (dimensions squared rows on the driver), largest first."""
    values, vectors = np.linalg.eigh(_square(covariance(points, weight).collect()))
    order = np.argsort(-values)
    rows = []
    for k, o in enumerate(order):
        v = vectors[:, o]
        rows.append((k, float(values[o]), [float(x) for x in v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)]))
    return points.sparkSession.createDataFrame(rows, "axis int, variance double, direction array<double>")


def intrinsic_dimension(points: DataFrame, edges: DataFrame) -> DataFrame:
    """i, dimension: trace over largest eigenvalue of each local covariance, over all dimensions; weights are not negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, share, gap in _centred(batch):
                gap = gap * np.sqrt(share)[:, None]
                values = np.linalg.eigvalsh(gap @ gap.T if len(gap) < gap.shape[1] else gap.T @ gap)  # the same but for zeros
                ids.append(i)
                found.append(float(values.sum() / values.max()) if values.max() > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], names=["i", "dimension"])

    return _neighbourhoods(points, edges).mapInArrow(run, "i long, dimension double")


def lda_direction(points: DataFrame, label: str, a: int, b: int) -> DataFrame:
    """dim, v: (C_a + C_b)^-1 (m_a - m_b)."""
    parts = [points.filter(F.col(label) == v) for v in (a, b)]
    cov = sum(_square(covariance(p).collect()) for p in parts)
    means = [np.array([r.m for r in sorted(to_cells(p).groupBy("dim").agg(F.avg("x").alias("m")).collect(), key=lambda r: r.dim)]) for p in parts]
    v = np.linalg.solve(cov, means[0] - means[1])
    return points.sparkSession.createDataFrame([(d, float(x)) for d, x in enumerate(v)], "dim int, v double")


# --- alignment --------------------------------------------------------------


def interpolate(embedding: DataFrame, weights: DataFrame) -> DataFrame:
    """id, y: weighted means of positions; weights are (id, lm, p) with lm an id of the embedding."""
    rows = weights.join(embedding.select(F.col("id").alias("lm"), "y"), "lm").select("id", "p", F.posexplode("y").alias("dim", "v"))
    sums = rows.groupBy("id", "dim").agg((F.sum(F.col("p") * F.col("v")) / F.sum("p")).alias("v"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda c: c["v"]).alias("y"))


def _unit(embedding: DataFrame, dim: int, name: str) -> DataFrame:
    box = bbox(embedding).filter(F.col("dim") == dim).select("lo", "hi")
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    return embedding.crossJoin(F.broadcast(box)).select("id", ((F.col("y")[dim] - F.col("lo")) / span).alias(name), span.alias(f"{name}_span"))


def equaliser_step(master: DataFrame, slave: DataFrame, previous: DataFrame, *, master_dim: int = 0, slave_dim: int = 0, connections: DataFrame | None = None, step: float = 0.02, momentum: float = 0.8, mult: float = 1.0) -> DataFrame:
    """id, y, delta of the slave after one step towards the master along one axis of each.

    Both are taken relative to their own box. Without connections an id follows
    the same id; with connections (id, master_id, w), the weighted mean of its
    masters. previous: id, delta. Where a 1-D master moves the y axis of a wider
    than tall slave, the slave's place is taken within the middle band that its
    aspect leaves.
    """
    m = _unit(master, master_dim, "m")
    if connections is not None:
        m = connections.join(m.select(F.col("id").alias("master_id"), "m"), "master_id").groupBy("id").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("m"))
    else:
        m = m.select("id", "m")
    s = _unit(slave, slave_dim, "s")
    place = F.col("s")
    if slave_dim == 1:
        other = _unit(slave, 0, "x").select("id", "x_span")
        s = s.join(other, "id")
        r = F.least(F.lit(1.0), F.col("s_span") / F.col("x_span"))
        place = F.col("s") * r + (1 - r) / 2
    moved = s.join(m, "id", "left").join(previous, "id", "left")
    delta = momentum * F.coalesce("delta", F.lit(0.0)) + F.coalesce(F.col("m") - place, F.lit(0.0)) * step * mult
    moved = moved.select("id", "s_span", delta.alias("delta"))
    new = F.transform("y", lambda v, i: F.when(i == slave_dim, v + F.col("delta") * F.col("s_span")).otherwise(v))
    return slave.join(moved, "id").select("id", new.alias("y"), "delta")
