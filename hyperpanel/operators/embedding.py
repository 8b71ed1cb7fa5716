"""Stochastic neighbour embedding: gradients, the optimiser, and its variants.

One step is a plan over embedding (id, y) and edges (i, j, w): the attractive
part joins the edges. For the repulsive one a task takes all points from a
broadcast matrix of bounded size (MOST_CELLS), or piles of near points: their
number is bounded (MOST_PILES), whatever the data, and a tree over them answers
for all. Whole runs keep the state of all points on the driver and sum forces by
ranges of points (``by_tasks``), in the same way whatever their number; edges lie in
the shared folder, a file for each range. ``embed_by_steps`` repeats the step's
plan instead, with the state stored after each.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calibrate, rng
from ..functions.vec import squared_distance, student_t
from ..sources import files
from . import tree as trees
from .field import field_forces, field_repulsion, fields, grid_of, pixel_centres
from .knn import BLOCK_CELLS, MOST_CELLS, _apart, _matrix
from .similarity import Parameters as GraphParameters
from .similarity import joint, symmetrised, walk_weights

#: Points up to which a progressive run is one task.
ONE_TASK = 20_000
#: Pairs of points that a task holds at once: few enough for a core's cache.
TILE_ROWS, TILE_COLUMNS = 128, 256
#: Squared distance from the middle up to which kernels are made of products.
MOST_SQUARE = 1e5
#: Points up to which the driver sums all pairs of a progressive step itself; beyond, tasks do. Rows of a task.
FEW_POINTS, ROWS_OF_TASK = 4_000, 2048
#: Rows of pixels of a task, and edges whose pull a task holds at once.
ROWS_OF_PIXELS, EDGES_AT_ONCE = 16, 1 << 18
#: Rows of a task, and pairs that a task fits at once, where all pairs are neighbours.
ROWS_OF_PAIRS, TILE_PAIRS = 512, 1 << 20
#: Chances that one eliminated state of a walk may add, and states whose square matrix the driver holds, at most.
MOST_FILL, MOST_CORE = 2048, 7_000
#: Piles of near points that are broadcast at most, and the width that a pile has at least (the kernel's own scale is 1).
MOST_PILES, LEAST_WIDTH = 1 << 20, 1 / 32


@dataclass(frozen=True)
class Parameters:
    dims: int = 2
    seed: int = 0
    spread: float = 0.1
    min_gain: float = 0.1
    eta: float = 200.0
    momentum: float = 0.2
    final_momentum: float = 0.5
    momentum_switch: int = 250
    exaggeration: float = 4.0
    exaggeration_stop: int = 250
    exaggeration_decay: int = 150
    baseline: float = 1.0
    theta: float = 0.0
    decay: str = "linear"  # linear | exponential | none
    repulsion: str = "exact"  # exact | tree | field | raster
    metric: str = "l2sq"


EXACT = Parameters(spread=1e-4, momentum=0.5, final_momentum=0.8, decay="none", metric="l2")


def exaggeration(t: int, p: Parameters) -> float:
    """Factor of the attractive forces at iteration ``t``."""
    if p.decay == "none":
        return p.exaggeration if t < p.exaggeration_stop else 1.0
    if t <= p.exaggeration_stop:
        return p.exaggeration
    if t > p.exaggeration_stop + p.exaggeration_decay:
        return p.baseline
    gone = t - p.exaggeration_stop
    if p.decay == "exponential":
        return p.baseline + (p.exaggeration - p.baseline) * float(np.exp(-gone / 30.0))
    return p.baseline + (p.exaggeration - p.baseline) * (1 - gone / p.exaggeration_decay)


def schedule(n: int) -> tuple[float, float]:
    """(theta, exaggeration) that suit ``n`` points."""
    if n < 1000:
        return 0.0, 1.5
    f = min(1.0, (n - 1000) / 14000)
    return 0.5 * f, 1.5 + 8.5 * f


def initial(points: DataFrame, p: Parameters) -> DataFrame:
    """id, y: normal positions from the portable generator, all dimensions filled."""
    ys = []
    for d in range(p.dims):
        pair = rng.normal_pair(p.seed * 31 + d // 2, F.col("id"))
        ys.append(pair[d % 2] * p.spread)
    return points.select("id", F.array(*ys).alias("y"))


# --- one step as a plan -----------------------------------------------------


def repelled(x: np.ndarray, wx: np.ndarray, y: np.ndarray, w: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(f, z) of rows of ``x`` from all of ``y``, but for their own places first to last; no more than a tile of pairs is held at a time.

    Squared distances are products of matrices where coordinates are so small that
    these keep ten digits of a kernel, else sums of squared gaps.
    """
    middle = y.mean(0) if len(y) else 0.0
    x, y = x - middle, y - middle
    dims = x.shape[1]
    moments = np.concatenate([w[:, None], w[:, None] * y], axis=1)
    squares = [(v * v).sum(1)[:, None] for v in (x, y)]
    near = max(v.max(initial=0.0) for v in squares) < MOST_SQUARE
    left = np.concatenate([-2 * x, np.ones((len(x), 1)), squares[0] + 1], axis=1)
    right = np.ascontiguousarray(np.concatenate([y, squares[1], np.ones((len(y), 1))], axis=1).T)
    z, sums, tile = np.zeros(len(x)), np.zeros((len(x), 1 + dims)), np.empty((TILE_ROWS, TILE_COLUMNS))
    for t in range(0, len(y), TILE_COLUMNS):
        b, m, c = y[t : t + TILE_COLUMNS], moments[t : t + TILE_COLUMNS], np.ascontiguousarray(right[:, t : t + TILE_COLUMNS])
        for s in range(0, len(x), TILE_ROWS):
            a, e, u = x[s : s + TILE_ROWS], first[s : s + TILE_ROWS], last[s : s + TILE_ROWS]
            q = tile[: len(a), : len(b)]
            if near:
                np.matmul(left[s : s + TILE_ROWS], c, out=q)
            else:
                q[:] = 1.0
                for d in range(dims):
                    gap = a[:, d, None] - b[None, :, d]
                    q += np.multiply(gap, gap, out=gap)
            np.reciprocal(q, out=q)
            if e.min() < t + len(b) and u.max() > t:
                for r in np.flatnonzero((e < t + len(b)) & (u > t)):
                    q[r, max(e[r] - t, 0) : u[r] - t] = 0
            z[s : s + TILE_ROWS] += q @ w[t : t + TILE_COLUMNS]
            sums[s : s + TILE_ROWS] += np.square(q, out=q) @ m
    return (x * sums[:, :1] - sums[:, 1:]) * wx[:, None], z * wx


def by_tasks(spark: SparkSession, n: int, run: Callable, *given: np.ndarray, rows: int | None = None) -> tuple[np.ndarray, ...]:
    """The arrays that ``run(given, first, last)`` returns for ranges of ``n`` rows, one after the other; each range is a task, and ranges don't depend on the cluster. A single range is run at once, with the same result."""
    rows = rows or ROWS_OF_TASK
    if n <= rows:
        return run(given, 0, n)
    every = spark.sparkContext.broadcast(given)
    starts = range(0, n, rows)
    found = spark.sparkContext.parallelize(starts, max(1, len(starts))).map(lambda s: run(every.value, s, min(s + rows, n))).collect()
    every.destroy()
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _repelled_rows(given: tuple[np.ndarray, np.ndarray], s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    y, w = given
    place = np.arange(s, e)
    return repelled(y[s:e], w[s:e], y, w, place, place + 1)


def repulsion_by_tasks(spark: SparkSession, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """(forces, Z) of all points on each other, exactly."""
    f, z = by_tasks(spark, len(y), _repelled_rows, y, w)
    return f, float(z.sum())


def kernel_sums(embedding: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """id, z, f: sum of kernels to all other points, and sum of q^2 (y_i - y_j); with weights (id, weight), both times w_i w_j."""
    n, width = embedding.agg(F.count(F.lit(1)), F.max(F.size("y"))).first()
    if n * (width or 0) > MOST_CELLS:
        raise ValueError("embeddings of this size need piled_sums")
    rows = embedding.select("id", "y") if weights is None else embedding.join(weights, "id").select("id", "y", "weight")
    table = rows.toArrow()
    own = (table.column("id").to_numpy(), _matrix(table, "y"), np.ones(n) if weights is None else table.column("weight").to_numpy())
    order = np.argsort(own[0], kind="stable")
    every = embedding.sparkSession.sparkContext.broadcast(tuple(v[order] for v in own))
    weighted = weights is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, w = every.value
        for batch in batches:
            if not batch.num_rows:
                continue
            i, x = batch.column("id").to_numpy(), _matrix(batch, "y")
            wi = batch.column("weight").to_numpy() if weighted else np.ones(len(i))
            f, z = repelled(x, wi, y, w, np.searchsorted(ids, i), np.searchsorted(ids, i, "right"))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(z), pa.array(list(f), pa.list_(pa.float64()))], names=["id", "z", "f"])

    return rows.mapInArrow(run, "id long, z double, f array<double>")


def piled_sums(embedding: DataFrame, weights: DataFrame | None = None, theta: float = 0.5, most: int = MOST_PILES, least: float = LEAST_WIDTH) -> DataFrame:
    """id, z, f as :func:`kernel_sums`, with a tree over piles of points in place of all points.

    Piles are cells of a grid over the box: at most ``most``, of width ``least`` or, in
    a wide box, as much wider as that takes. A pile stands for its points by mass
    and centre; a point's own pile answers without the point. Piles are summed
    before they are shuffled, and only they reach the driver.
    """
    rows = embedding.select("id", "y", F.lit(1.0).alias("weight")) if weights is None else embedding.join(weights, "id").select("id", "y", "weight")
    dims = (embedding.agg(F.max(F.size("y"))).first()[0]) or 1
    box = rows.agg(*(f(F.col("y")[k]) for k in range(dims) for f in (F.min, F.max))).first()
    low, high = np.array([v or 0.0 for v in box[::2]]), np.array([v or 0.0 for v in box[1::2]])
    side = max(int(most ** (1 / dims) + 1e-9), 1)
    width = max(float((high - low).max()) / side * (1 + 1e-12), least)

    def cells(y: np.ndarray) -> np.ndarray:
        at = np.clip(((y - low) / width).astype(np.int64), 0, side - 1)
        return (at * side ** np.arange(dims)).sum(1)

    def pile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, w = _matrix(batch, "y"), batch.column("weight").to_numpy()
                key, at = np.unique(cells(y), return_inverse=True)
                sums = [np.bincount(at, w), *(np.bincount(at, w * y[:, k]) for k in range(dims))]
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], names=["cell", "mass", *(f"m{k}" for k in range(dims))])

    moments = [f"m{k}" for k in range(dims)]
    piles = rows.mapInArrow(pile, "cell long, mass double, " + ", ".join(f"{m} double" for m in moments))
    table = piles.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("mass", *moments))).filter("mass > 0").orderBy("cell").toArrow()  # at most ``most`` rows
    keys, mass = table.column("cell").to_numpy(), table.column("mass").to_numpy()
    moment = np.stack([table.column(m).to_numpy() for m in moments], axis=1)
    every = embedding.sparkSession.sparkContext.broadcast((keys, mass, moment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, mass, moment = every.value
            if tree is None:
                tree = trees.Tree(moment / np.maximum(mass, 1e-300)[:, None], mass) if len(keys) else None
            y, w = _matrix(batch, "y"), batch.column("weight").to_numpy()
            z, f = np.zeros(len(y)), np.zeros_like(y)
            for s in range(0, len(y), 1024):
                x, own = y[s : s + 1024], w[s : s + 1024]
                at = np.clip(np.searchsorted(keys, cells(x)), 0, max(len(keys) - 1, 0))
                if tree is None:
                    continue
                f[s : s + 1024], z[s : s + 1024] = tree.sums(x, own, at, mass[at], theta)
                rest = mass[at] - own  # what shares the pile
                shared = rest > 1e-9 * mass[at]
                gap = np.where(shared[:, None], x - (moment[at] - own[:, None] * x) / np.where(shared, rest, 1)[:, None], 0)
                q = 1 / (1 + (gap * gap).sum(1))
                m = np.where(shared, rest * own, 0) * q
                z[s : s + 1024] += m
                f[s : s + 1024] += (m * q)[:, None] * gap
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(z), pa.array(list(f), pa.list_(pa.float64()))], names=["id", "z", "f"])

    return rows.mapInArrow(run, "id long, z double, f array<double>")


def normaliser(embedding: DataFrame) -> DataFrame:
    """One row: Z, the sum of kernels over ordered pairs."""
    return kernel_sums(embedding).agg(F.sum("z").alias("z"))


def attraction(embedding: DataFrame, edges: DataFrame) -> DataFrame:
    """id, a: sum of w q (y_i - y_j) over the edges."""
    yi, yj = embedding.select(F.col("id").alias("i"), F.col("y").alias("yi")), embedding.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    rows = edges.filter("i <> j").join(yi, "i").join(yj, "j")
    pull = F.zip_with("yi", "yj", lambda a, b: a - b)
    each = rows.select("i", (F.col("w") * student_t(squared_distance(F.col("yi"), F.col("yj")))).alias("m"), pull.alias("g")).select("i", F.posexplode("g").alias("dim", "g"), "m")
    sums = each.groupBy("i", "dim").agg(F.sum(F.col("m") * F.col("g")).alias("a"))
    return sums.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "a"))), lambda c: c["a"]).alias("a"))


def gradient(embedding: DataFrame, edges: DataFrame, factor: float = 1.0, weights: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """id, g = 4 (factor * attraction - repulsion / Z); ``edges`` sum to one, ``sums`` are those of :func:`kernel_sums` unless given."""
    sums = _stored(kernel_sums(embedding, weights), "sums")[0] if sums is None else sums  # they are read twice
    total = sums.agg(F.sum("z").alias("total"))
    rows = embedding.join(sums, "id").join(attraction(embedding, edges), "id", "left").crossJoin(F.broadcast(total))  # one row
    zero = F.transform("y", lambda v: F.lit(0.0))
    return rows.select("id", F.zip_with(F.coalesce("a", zero), F.transform("f", lambda v: v / F.col("total")), lambda a, r: 4.0 * (factor * a - r)).alias("g"))


def updated(state: DataFrame, grad: DataFrame, p: Parameters, t: int, mult: float = 1.0) -> DataFrame:
    """state (id, y, v, gain) after one step: gains grow while directions agree, velocities carry momentum."""
    momentum = p.momentum if t < p.momentum_switch else p.final_momentum
    rows = state.join(grad, "id")
    gain = F.zip_with("gain", F.zip_with("g", "v", lambda g, v: F.signum(g) != F.signum(v)), lambda n, up: F.greatest(F.lit(p.min_gain), F.when(up, n + 0.2).otherwise(n * 0.8)))
    rows = rows.withColumn("gain", gain)
    push = F.zip_with("gain", "g", lambda n, g: p.eta * n * g)
    rows = rows.withColumn("v", F.zip_with("v", push, lambda v, s: momentum * v - s))
    return rows.select("id", F.zip_with("y", "v", lambda y, v: y + mult * v).alias("y"), "v", "gain")


def kullback_leibler(embedding: DataFrame, edges: DataFrame) -> DataFrame:
    """kl: sum of p ln(p / (q / Z)) over edges that sum to one."""
    yi, yj = embedding.select(F.col("id").alias("i"), F.col("y").alias("yi")), embedding.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    q = edges.filter("i <> j AND w > 0").join(yi, "i").join(yj, "j").select("w", student_t(squared_distance(F.col("yi"), F.col("yj"))).alias("q"))
    return q.crossJoin(F.broadcast(normaliser(embedding))).agg(F.sum(F.col("w") * F.log(F.col("w") / (F.col("q") / F.col("z")))).alias("kl"))


# --- whole runs -------------------------------------------------------------


@dataclass
class State:
    ids: np.ndarray
    y: np.ndarray
    v: np.ndarray
    gain: np.ndarray
    t: int = 0


def _repulsion(y: np.ndarray, w: np.ndarray, p: Parameters) -> tuple[np.ndarray, float]:
    """(forces, Z) of all points on each other."""
    if p.repulsion in ("field", "raster"):
        return field_repulsion(y, raster=p.repulsion == "raster")
    if p.repulsion == "tree" or p.theta > 0:
        return trees.Tree(y, w).repulsion(y, w, p.theta or 1e-9)
    place = np.arange(len(y))
    f, z = repelled(y, w, y, w, place, place + 1)
    return f, float(z.sum())


def numpy_gradient(y: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, factor: float, weights: np.ndarray, p: Parameters, spark: SparkSession | None = None) -> np.ndarray:
    """With a session, exact repulsion of more than FEW_POINTS is summed by tasks."""
    exact = p.repulsion == "exact" and p.theta == 0
    f, z = repulsion_by_tasks(spark, y, weights) if spark is not None and exact and len(y) > FEW_POINTS else _repulsion(y, weights, p)
    gap = y[i] - y[j]
    pull = (w / (1 + (gap * gap).sum(1)))[:, None] * gap
    a = np.stack([np.bincount(i, pull[:, d], len(y)) for d in range(y.shape[1])], axis=1)
    return 4 * (factor * a - f / max(z, 1e-300))


def iterate(state: State, i: np.ndarray, j: np.ndarray, w: np.ndarray, p: Parameters, weights: np.ndarray | None = None, mult: float = 1.0, spark: SparkSession | None = None) -> State:
    """The state one iteration later; (i, j, w) are places and weights that sum to one."""
    g = numpy_gradient(state.y, i, j, w, exaggeration(state.t, p), np.ones(len(state.y)) if weights is None else weights, p, spark)
    return advanced(state, g, p, mult)


def advanced(state: State, g: np.ndarray, p: Parameters, mult: float = 1.0) -> State:
    """The state one iteration later, by its gradient."""
    factor = exaggeration(state.t, p)
    gain = np.maximum(p.min_gain, np.where(np.sign(g) != np.sign(state.v), state.gain + 0.2, state.gain * 0.8))
    v = (p.momentum if state.t < p.momentum_switch else p.final_momentum) * state.v - p.eta * gain * g
    y = state.y + mult * v
    low, high = y.min(0), y.max(0)
    y = y - (low + high) / 2
    if factor > 1.2 and 0 < high[0] - low[0] < 0.1:
        y = y * (0.1 / (high[0] - low[0]))
    return State(state.ids, y, v, gain, state.t + 1)


def divergence(y: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> float:
    _, z = _repulsion(y, np.ones(len(y)), Parameters())
    gap = y[i] - y[j]
    ok = (w > 0) & (i != j)
    return float((w[ok] * np.log(w[ok] / ((1 / (1 + (gap * gap).sum(1)))[ok] / z))).sum())


def start(ids: np.ndarray, y: np.ndarray) -> State:
    return State(ids, y.copy(), np.zeros_like(y), np.ones_like(y))


def progressive(embedding: DataFrame, edges: DataFrame, p: Parameters, iterations: int, every: int = 50, weights: DataFrame | None = None) -> Iterator[tuple[int, pd.DataFrame]]:
    """(iteration, frame of id and y0, y1, ...) as the run advances; for embeddings that fit the driver (ONE_TASK)."""
    state, i, j, w, mass = _local(embedding, edges, weights)
    while state.t < iterations:
        state = iterate(state, i, j, w, p, mass, spark=embedding.sparkSession)
        if state.t % every == 0 or state.t == iterations:
            yield state.t, pd.DataFrame({"id": state.ids} | {f"y{d}": state.y[:, d] for d in range(state.y.shape[1])})


def _local(embedding: DataFrame, edges: DataFrame, weights: DataFrame | None):
    n = embedding.count()
    if n > ONE_TASK:
        raise ValueError(f"whole runs hold at most {ONE_TASK} points; embed landmarks of a hierarchy instead")
    table = embedding.select("id", "y").orderBy("id").toArrow()
    ids = table.column("id").to_numpy()
    e = edges.filter("i <> j").select("i", "j", "w").toArrow()
    i, j = (np.searchsorted(ids, e.column(c).to_numpy()) for c in ("i", "j"))
    w = e.column("w").to_numpy()
    mass = None
    if weights is not None:
        m = weights.select("id", "weight").orderBy("id").toArrow()
        mass = m.column("weight").to_numpy()
    return start(ids, _matrix(table, "y")), i, j, w / w.sum(), mass


class _Cloud:
    """Points and masses that the tasks of a step share; a worker builds the tree over them once."""

    def __init__(self, y: np.ndarray, w: np.ndarray):
        self.y, self.w = y, w

    def __reduce__(self):
        return _Cloud, (self.y, self.w)

    @cached_property
    def tree(self) -> trees.Tree:
        return trees.Tree(self.y, self.w)


def _written(path: str, *arrays: np.ndarray) -> None:
    """One file of the arrays' bytes, moved when it is whole."""
    store, at = files.located(path)
    hidden = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    if store.get_file_info(at).type != fs.FileType.NotFound:
        store.delete_file(hidden)  # another attempt wrote the same
        return
    store.move(hidden, at)


def edge_files(edges: DataFrame, ids: np.ndarray) -> tuple[str, dict[int, int], float]:
    """A folder with a file of the edges (as places of ``ids``) of each range of ROWS_OF_TASK points, numbers of edges by a range's start, and the sum of their weights."""
    spark, rows = edges.sparkSession, ROWS_OF_TASK
    every, path = spark.sparkContext.broadcast(ids), files.folder(spark, "edges")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, w = (batch.column(c).to_numpy() for c in ("i", "j", "w"))
            a, b = (np.minimum(np.searchsorted(every.value, v), len(every.value) - 1) for v in (i, j))
            both = (every.value[a] == i) & (every.value[b] == j)
            a, b = a[both], b[both]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (a // rows * rows, a, b, w[both]))], names=["start", "i", "j", "w"])

    def packed(table: pa.Table) -> pa.Table:
        i, j, w = (table.column(c).to_numpy() for c in ("i", "j", "w"))
        order = np.lexsort((w, j, i))
        first = table.column("start")[0].as_py()
        _written(f"{path}/{first}", i[order], j[order], w[order])
        return pa.table({"start": [first], "n": [len(w)], "total": [float(w[order].sum())]})

    kept = edges.filter("i <> j AND w IS NOT NULL").select(*(F.col(c).cast(t) for c, t in (("i", "long"), ("j", "long"), ("w", "double"))))
    found = sorted(kept.mapInArrow(placed, "start long, i long, j long, w double").groupBy("start").applyInArrow(packed, "start long, n long, total double").collect())
    every.destroy()
    return path, {r.start: r.n for r in found}, sum(r.total for r in found)


def _pulled(y: np.ndarray, path: str, edges: dict[int, int], total: float, s: int, e: int) -> np.ndarray:
    """Sums of w q (y_i - y_j) over the edges of rows s to e."""
    a = np.zeros((e - s, y.shape[1]))
    if not (n := edges.get(s, 0)):
        return a
    store, at = files.located(f"{path}/{s}")
    with store.open_input_file(at) as f:
        data = np.frombuffer(f.read(), np.int64)
    i, j, w = data[:n], data[n : 2 * n], data[2 * n :].view(float)
    for t in range(0, n, EDGES_AT_ONCE):
        u = slice(t, t + EDGES_AT_ONCE)
        gap = y[i[u]] - y[j[u]]
        pull = (w[u] / total / (1 + (gap * gap).sum(1)))[:, None] * gap
        for d in range(y.shape[1]):
            a[:, d] += np.bincount(i[u] - s, pull[:, d], e - s)
    return a


def _forces(cloud: _Cloud, p: Parameters, path: str, edges: dict[int, int], total: float, s: int, e: int) -> tuple[np.ndarray, ...]:
    """(attraction, repulsion, z) of rows s to e; those of fields are made by pixels."""
    x, w, place = cloud.y[s:e], cloud.w[s:e], np.arange(s, e)
    if p.repulsion in ("field", "raster"):
        f, z = np.zeros_like(x), np.zeros(e - s)
    elif p.repulsion == "tree" or p.theta > 0:
        f, z = cloud.tree.sums(x, w, place, w, p.theta or 1e-9)
    else:
        f, z = repelled(x, w, cloud.y, cloud.w, place, place + 1)
    return _pulled(cloud.y, path, edges, total, s, e), f, z


def _field_by_tasks(spark: SparkSession, y: np.ndarray, raster: bool) -> tuple[np.ndarray, float]:
    """:func:`field_repulsion` whose pixels are summed by tasks, so many rows each."""
    low, extent, size = grid_of(y)
    xs, ys = pixel_centres(low, extent, size)
    (rows,) = by_tasks(spark, len(ys), lambda given, s, e: (np.moveaxis(fields(given[0], xs, ys[s:e], raster), 0, 1),), y, rows=ROWS_OF_PIXELS)
    return field_forces(np.moveaxis(rows, 1, 0), low, extent, y)


def embed(embedding: DataFrame, edges: DataFrame, p: Parameters, iterations: int, weights: DataFrame | None = None) -> DataFrame:
    """id, y after ``iterations``, by the same sums whatever the number of points: all pairs, a tree over all points, or fields.

    The driver holds the state, some hundred bytes a point; tasks sum the forces.
    """
    spark = embedding.sparkSession
    table = embedding.select("id", "y").orderBy("id").toArrow()
    ids = table.column("id").to_numpy()
    state = start(ids, _matrix(table, "y"))
    if not len(ids) or not iterations:
        return _frame(embedding, state)
    mass = np.ones(len(ids))
    if weights is not None:
        m = embedding.select("id").join(weights.select("id", "weight"), "id", "left").orderBy("id").toArrow()
        mass = m.column("weight").fill_null(0.0).to_numpy()
    path, counts, total = edge_files(edges, ids)
    for _ in range(iterations):
        a, f, z = by_tasks(spark, len(ids), lambda given, s, e: _forces(given[0], p, path, counts, total, s, e), _Cloud(state.y, mass))
        if p.repulsion in ("field", "raster"):
            f, sums = _field_by_tasks(spark, state.y, p.repulsion == "raster")
        else:
            sums = float(z.sum())
        state = advanced(state, 4 * (exaggeration(state.t, p) * a - f / max(sums, 1e-300)), p)
    _dropped(path)
    return _frame(embedding, state)


def embed_by_steps(embedding: DataFrame, edges: DataFrame, p: Parameters, iterations: int, weights: DataFrame | None = None) -> DataFrame:
    """id, y after ``iterations``, each a plan over all points and edges; only piles of points and sums reach the driver.

    Repulsion is exact where ``p`` asks for it and the points fit a broadcast
    (MOST_CELLS); else, also for fields, it is that of :func:`piled_sums`. The state
    is stored after each step in the shared folder, and the one before is dropped.
    """
    cells = embedding.agg(F.sum(F.size("y"))).first()[0] or 0
    exact = p.repulsion == "exact" and p.theta == 0 and cells <= MOST_CELLS
    kept = edges.filter("i <> j").select("i", "j", "w")
    total = kept.agg(F.sum("w").alias("total"))  # one row
    kept = _stored(kept.crossJoin(F.broadcast(total)).select("i", "j", (F.col("w") / F.col("total")).alias("w")), "edges")[0]
    state, path = _stored(embedding.select("id", "y", F.transform("y", lambda v: F.lit(0.0)).alias("v"), F.transform("y", lambda v: F.lit(1.0)).alias("gain")), "state")
    dims = state.agg(F.max(F.size("y"))).first()[0] or 0
    for t in range(iterations if dims else 0):
        y, factor = state.select("id", "y"), exaggeration(t, p)
        sums, spent = _stored(kernel_sums(y, weights) if exact else piled_sums(y, weights, p.theta or 0.5), "sums")
        moved, step = _stored(updated(state, gradient(y, kept, factor, weights, sums), p, t), "state")
        box = moved.agg(*(f(F.col("y")[k]) for k in range(dims) for f in (F.min, F.max))).first()
        middle = [(a + b) / 2 for a, b in zip(box[::2], box[1::2], strict=True)]
        extent = box[1] - box[0]
        scale = 0.1 / extent if factor > 1.2 and 0 < extent < 0.1 else 1.0
        state = moved.withColumn("y", F.array(*((F.col("y")[k] - middle[k]) * scale for k in range(dims))))
        for old in (spent, path):
            _dropped(old)
        path = step
    return state.select("id", "y")


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table in the shared folder, and where it is."""
    path = files.folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _dropped(path: str) -> None:
    store, at = files.located(path)
    store.delete_dir(at)


def _frame(like: DataFrame, state: State) -> DataFrame:
    rows = pa.array(list(state.y), pa.list_(pa.float64()))
    return like.sparkSession.createDataFrame(pa.table({"id": pa.array(state.ids, pa.int64()), "y": rows}), "id long, y array<double>")


def tsne(points: DataFrame, graph: GraphParameters = GraphParameters(), p: Parameters = Parameters(), iterations: int = 1000) -> DataFrame:
    """Sparse embedding of points; ``p`` chooses exact, tree, field or raster repulsion."""
    return embed(initial(points, p), joint(points, graph), p, iterations)


class _Blocks:
    """All points in files of the shared folder, in order of ids: tasks read them block by block, or a run of rows."""

    def __init__(self, path: str, starts: np.ndarray, width: int, middle: np.ndarray):
        self.path, self.starts, self.width, self.middle = path, starts, width, middle

    def _read(self, b: int, s: int, e: int) -> np.ndarray:
        store, at = files.located(f"{self.path}/{self.starts[b]}")
        with store.open_input_file(at) as f:
            data = f.read_at((e - s) * self.width * 8, (s - int(self.starts[b])) * self.width * 8)
        return np.frombuffer(data, float).reshape(e - s, self.width) - self.middle

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for b in range(len(self.starts) - 1):
            yield int(self.starts[b]), self._read(b, int(self.starts[b]), int(self.starts[b + 1]))

    def rows(self, s: int, e: int) -> np.ndarray:
        own = range(int(np.searchsorted(self.starts, s, "right")) - 1, int(np.searchsorted(self.starts, e)))
        return np.concatenate([self._read(b, max(s, int(self.starts[b])), min(e, int(self.starts[b + 1]))) for b in own])


def point_files(points: DataFrame, ids: np.ndarray) -> _Blocks:
    """Blocks of at most BLOCK_CELLS cells (and of the points of an id) of all points, less their mean; ``ids`` are those of all points, sorted."""
    spark = points.sparkSession
    first = points.select(F.size("features").alias("n")).first()
    width = max(1, first[0] if first else 1)
    bounds = np.unique(ids[:: max(1, BLOCK_CELLS // width // ROWS_OF_PAIRS) * ROWS_OF_PAIRS])
    starts = np.append(np.searchsorted(ids, bounds), len(ids))
    every, path = spark.sparkContext.broadcast((bounds, starts)), files.folder(spark, "points")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, starts = every.value
        for batch in batches:
            at = starts[np.searchsorted(bounds, batch.column("id").to_numpy(), "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["start", "id", "features"])

    def packed(table: pa.Table) -> pa.Table:
        x = _matrix(table)[np.argsort(table.column("id").to_numpy(), kind="stable")]
        start = table.column("start")[0].as_py()
        _written(f"{path}/{start}", x)
        return pa.table({"start": [start], "n": [len(x)], "sums": pa.array([x.sum(0)], pa.list_(pa.float64()))})

    rows = points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    found = sorted(rows.mapInArrow(placed, "start long, id long, features array<double>").groupBy("start").applyInArrow(packed, "start long, n long, sums array<double>").collect())
    every.destroy()
    return _Blocks(path, starts, width, sum(np.array(r.sums) for r in found) / max(1, len(ids)))


def exact_tsne(points: DataFrame, perplexity: float = 30.0, p: Parameters = EXACT, iterations: int = 1000) -> DataFrame:
    """Embedding from all pairs: every other point is a neighbour, on plain distances.

    Probabilities are no rows, and points lie in files of the shared folder: a task
    holds a block of them (BLOCK_CELLS) and each row's fit, and makes the
    probabilities of a tile of pairs anew in each step, whatever the number of points.
    """
    begun = initial(points, p).select("id", "y").orderBy("id").toArrow()
    spark, n = points.sparkSession, begun.num_rows
    state = start(begun.column("id").to_numpy(), _matrix(begun, "y"))
    if n < 2 or not iterations:
        return _frame(points, state)
    data = point_files(points, state.ids)
    fit = by_tasks(spark, n, lambda _, s, e: _fit_rows(data, s, e, perplexity, p.metric), rows=ROWS_OF_PAIRS)
    for _ in range(iterations):
        a, f, z = by_tasks(spark, n, lambda given, s, e: _all_pairs(data, *given, s, e, p.metric), state.y, *fit, rows=ROWS_OF_PAIRS)
        state = advanced(state, 4 * (exaggeration(state.t, p) * a - f / max(float(z.sum()), 1e-300)), p)
    _dropped(data.path)
    return _frame(points, state)


def _fit_rows(data: _Blocks, s: int, e: int, perplexity: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(beta, c) of rows s to e: the chance of j after i is exp(c_i - beta_i d_ij); rows without a fit are even."""
    n, x = int(data.starts[-1]), data.rows(s, e)
    step = max(1, TILE_PAIRS // n)
    out = []
    for r in range(s, e, step):
        u = x[r - s : r - s + step]
        d = np.empty((len(u), n))
        for t, block in data:
            d[:, t : t + len(block)] = _apart(u, block, metric)
        own = np.arange(len(d))
        d[own, own + r] = np.inf
        least = d.min(1)
        valid = np.isfinite(d)
        d -= least[:, None]
        d[~valid] = 0.0
        beta, found = calibrate.fitted(d, perplexity, valid=valid)
        beta = np.where(found, beta, 0.0)
        total = np.where(valid, np.exp(-beta[:, None] * d), 0.0).sum(1)
        out.append((beta, beta * least - np.log(total)))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _all_pairs(data: _Blocks, y: np.ndarray, beta: np.ndarray, c: np.ndarray, s: int, e: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, f, z) of rows s to e: attraction by the symmetrised chances of all pairs, which sum to one, and the sums of :func:`repelled`."""
    n, x = len(y), data.rows(s, e)
    place = np.arange(s, e)
    f, z = repelled(y[s:e], np.ones(e - s), y, np.ones(n), place, place + 1)
    a = np.zeros_like(y[s:e])
    for begin, block in data:
        for r in range(s, e, TILE_ROWS):
            u = slice(r, min(r + TILE_ROWS, e))
            for t in range(begin, begin + len(block), TILE_COLUMNS):
                v = slice(t, min(t + TILE_COLUMNS, begin + len(block)))
                d = _apart(x[u.start - s : u.stop - s], block[v.start - begin : v.stop - begin], metric)
                m = np.exp(c[u, None] - beta[u, None] * d)
                m += np.exp(c[v] - np.multiply(d, beta[v], out=d), out=d)
                gaps = [y[u, k, None] - y[v, k] for k in range(y.shape[1])]
                q = 1.0 + sum(g * g for g in gaps)
                np.divide(m, q, out=m)
                m *= np.arange(u.start, u.stop)[:, None] != np.arange(v.start, v.stop)
                for k, g in enumerate(gaps):
                    a[r - s : u.stop - s, k] += np.einsum("ij,ij->i", m, g)
    return a / (2 * n), f, z


def weighted_tsne(points: DataFrame, graph: GraphParameters = GraphParameters(), p: Parameters = Parameters(decay="exponential"), iterations: int = 1000, weights: DataFrame | None = None) -> DataFrame:
    """Points repel by weight; without weights these are the row sums of the joint probabilities."""
    edges = _stored(joint(points, graph), "edges")[0]  # they are read twice
    weights = weights if weights is not None else row_sums(edges)
    return embed(initial(points, p), edges, p, iterations, weights)


def row_sums(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("weight"))


def met_first(p: np.ndarray, stops: int, block: int = 128) -> np.ndarray:
    """Chances that walks from each of the last ``stops`` states of a chain first meet each other one, without a limit of steps.

    ``p`` is overwritten. The other states are eliminated in blocks; a state is
    left by the sum of what leads out of it, never by one less what stays, so
    chances keep their accuracy where walks stay between few states for long.
    States that nothing leaves take their walks with them. The start is passed
    through; rows are those of walks that end, and sum to one or are 0.
    """
    m = len(p) - stops
    for s in range(0, m, block):
        e = min(s + block, m)
        own = np.concatenate([p[s:e, s:e], p[s:e, e:].sum(1, keepdims=True)], axis=1)  # the block's columns, and the sums of all later ones
        mixed = np.eye(e - s)  # rows of the block, as sums of those before
        for k in range(e - s):
            out = own[k, k + 1 :].sum()
            own[k, k + 1 :] = own[k, k + 1 :] / out if out > 0 else 0.0
            mixed[k] = mixed[k] / out if out > 0 else 0.0
            own[k + 1 :, k + 1 :] += np.outer(own[k + 1 :, k], own[k, k + 1 :])
            mixed[k + 1 :] += np.outer(own[k + 1 :, k], mixed[k])
        through = np.eye(e - s)  # visits to the block's states, those before first
        for k in range(e - s - 2, -1, -1):
            through[k, k + 1 :] = own[k, k + 1 : e - s] @ through[k + 1 :, k + 1 :]
        later = mixed @ p[s:e, e:]
        for r in range(e, len(p), 1024):
            p[r : r + 1024, e:] += (p[r : r + 1024, s:e] @ through) @ later
    met = p[m:, m:].copy()
    np.fill_diagonal(met, 0.0)
    total = met.sum(1, keepdims=True)
    return np.divide(met, total, out=np.zeros_like(met), where=total > 0)


def shortened(rows: dict[int, dict[int, float]], kept: set[int], most: int, lost: int) -> None:
    """Eliminate states of a chain (state: target: chance, without stays) in place, but for ``kept``, those first that are between few others, until each is between more than ``most`` pairs.

    Chances are only compared within a row: what stays is left out, never subtracted.
    A row whose other chances are too small for a double leads to ``lost``.
    """
    for a, row in rows.items():
        total = sum(row.values())
        rows[a] = {b: v / total for b, v in row.items()} if total > 0 else row
    into = {a: set() for a in rows if a not in kept}
    for a, row in rows.items():
        for b in row:
            if b in into:
                into[b].add(a)
    heap = [(len(into[a]) * len(rows[a]), a) for a in into]
    heapq.heapify(heap)
    while heap:
        cost, a = heapq.heappop(heap)
        if a not in into or cost != (now := len(into[a]) * len(rows[a])):
            if a in into:
                heapq.heappush(heap, (now, a))
            continue
        if cost > most:
            break
        own = rows.pop(a)
        if not (total := sum(own.values())) > 0:
            own, total = {lost: 1.0}, 1.0
        for b in own:
            if b in into:
                into[b].discard(a)
        for q in into.pop(a):
            row = rows[q]
            share = row.pop(a) / total
            for b, v in own.items():
                if b != q and (more := share * v) > 0:
                    row[b] = row.get(b, 0.0) + more
                    if b in into:
                        into[b].add(q)
            if q in own:
                left = sum(row.values())
                rows[q] = {b: v / left for b, v in row.items()} if left > 0 else {lost: 1.0}
            if q in into:
                heapq.heappush(heap, (len(into[q]) * len(rows[q]), q))


def reaching(i: np.ndarray, j: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``found`` (a flag for each state), and all states that steps i to j lead from to one of them."""
    found = found.copy()
    while (new := i[found[j] & ~found[i]]).size:
        found[new] = True
    return found


def meetings(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """i, j, w: chances that a walk from landmark i meets j first of the other landmarks, of walks that meet one.

    Solved on the driver. Points that no landmark is reached from are one state,
    where walks end. Others are eliminated while few (MOST_FILL) chances are added
    for each; the square matrix of the rest lies on disk beyond MOST_CORE states.
    """
    marks = np.sort(landmarks.select("id").distinct().toArrow().column("id").to_numpy())
    e = edges.filter("w > 0").select("i", "j", "w").toArrow()
    i, j, w = (e.column(c).to_numpy() for c in ("i", "j", "w"))
    ids = np.union1d(np.union1d(i, j), marks)
    i, j, at = (np.searchsorted(ids, v) for v in (i, j, marks))
    stops, lost = np.zeros(len(ids), bool), len(ids)
    stops[at] = True
    ends, met = reaching(i, j, stops), reaching(j, i, stops)
    rows: dict[int, dict[int, float]] = {int(a): {} for a in np.flatnonzero(ends & met | stops)}
    used = ends[i] & met[i] & (i != j)
    for a, b, v in zip(i[used].tolist(), np.where(ends[j], j, lost)[used].tolist(), w[used].tolist(), strict=True):
        rows[a][b] = rows[a].get(b, 0.0) + v
    shortened(rows, set(at.tolist()), MOST_FILL, lost)
    states = [*sorted(rows.keys() - set(at.tolist())), *at.tolist(), lost]
    place = {a: k for k, a in enumerate(states)}
    with tempfile.TemporaryFile() as f:
        p = np.zeros((len(states), len(states))) if len(states) <= MOST_CORE else np.memmap(f, float, "w+", shape=(len(states), len(states)))
        for a, row in rows.items():
            p[place[a], [place[b] for b in row]] = list(row.values())
        rows.clear()
        found = met_first(p, len(at) + 1, 512 if len(p) > MOST_CORE else 128)[:-1, :-1]
        del p
    total = found.sum(1, keepdims=True)
    found = np.divide(found, total, out=np.zeros_like(found), where=total > 0)
    a, b = np.nonzero(found)
    pairs = [(int(marks[x]), int(marks[y]), float(found[x, y])) for x, y in zip(a, b, strict=True)]
    return edges.sparkSession.createDataFrame(pairs, "i long, j long, w double")


def random_walk_tsne(points: DataFrame, landmarks: int = 100, neighbours: int = 30, seed: int = 0, p: Parameters = EXACT, iterations: int = 500) -> DataFrame:
    """Embedding of random landmarks, related by where walks from one first meet another: the limit of many walks, however long."""
    edges = walk_weights(points, neighbours)
    chosen = points.select("id").withColumn("u", rng.uniform(seed, F.col("id"))).orderBy("u", "id").limit(landmarks).select("id")
    return embed(initial(chosen, p), symmetrised(meetings(edges, chosen)), p, iterations)


def repaired_rows(edges: DataFrame, nodes: DataFrame, least: int = 7, seed: int = 0) -> DataFrame:
    """Edges, with random targets of weight 1 / missing added to rows of fewer than ``least`` entries."""
    n = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    numbered = nodes.select(F.col("id").alias("j"), (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("number"))
    total = nodes.count()
    short = nodes.select(F.col("id").alias("i")).join(n, "i", "left").withColumn("missing", least - F.coalesce("n", F.lit(0).cast("long"))).filter("missing > 0")
    draws = short.select("i", "missing", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)).alias("k"))
    draws = draws.withColumn("number", F.pmod(rng.number(seed, F.col("i") * least + F.col("k")), F.lit(total)))
    return edges.select("i", "j", "w").unionByName(draws.join(numbered, "number").select("i", "j", (1.0 / F.col("missing")).alias("w")))


def with_schedule(p: Parameters, n: int) -> Parameters:
    theta, factor = schedule(n)
    return replace(p, theta=theta, exaggeration=factor, exaggeration_stop=170)
