"""Graph and Markov-chain operators over edges (i, j, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from .embedding import _dropped, _stored
from .similarity import row_cdf, row_normalised

#: Edges and vertices of a graph that is broadcast for walks, at most; walks over larger ones join each step.
MOST_EDGES = 4_000_000
#: Walks that a task follows at once.
WALKS_AT_ONCE = 1 << 18


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def threshold(edges: DataFrame, t: float) -> DataFrame:
    """Edges strictly above ``t``."""
    return edges.filter(F.col("w") > t)


def lookup(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """i, j, w for each key (i, j); absent cells are 0."""
    return keys.join(edges, ["i", "j"], "left").select("i", "j", F.coalesce("w", F.lit(0.0)).alias("w"))


#: A key is hot if it holds more than this share of the rows that are looked up, and more than LEAST_HOT rows: at most 1 / HOT keys are.
HOT, LEAST_HOT = 1 / 1000, 100


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """The few keys that hold a large share of the rows (at most 1 / HOT of them)."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAST_HOT)
    if not (total := rows.count()):
        return []
    return [r[0] for r in counts.filter(F.col("n") > total * HOT).select(key).collect()]


def lookup_by(rows: DataFrame, key: str, table: DataFrame, hot: list[int], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key; rows of the hot keys meet theirs by broadcast, the rest by a shuffle."""
    if not hot:
        return rows.join(table, key, how)
    often = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.filter(F.col(key).isin(hot)))  # a row for each hot key
    return rows.filter(~often).join(table, key, how).unionByName(rows.filter(often).join(few, key, how))


def smallest_labels(near: DataFrame, labels: DataFrame, cut, drop=lambda df: None) -> DataFrame:
    """node, label of ``labels``, lowered until each label is the smallest of its component.

    near: i, j, both ways, stored. Labels take the smallest of their neighbours
    and then the label of their label, until none changes. ``cut`` stores each
    round, ``drop`` deletes what is read no more. A vertex with many neighbours
    and a label with many vertices travel by broadcast.
    """
    hubs = hot_keys(near, "j")
    while True:
        least = lookup_by(near, "j", labels.select(F.col("node").alias("j"), "label"), hubs).groupBy("i").agg(F.min("label").alias("near"))
        step = cut(labels.join(least.withColumnRenamed("i", "node"), "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was")))
        beyond = step.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = cut(lookup_by(step, "label", beyond, hot_keys(step, "label")).select("node", F.least("label", "beyond").alias("label"), "was"))
        moved = new.filter("label <> was").limit(1).count()
        drop(step)
        drop(labels)
        labels = new.select("node", "label")
        if not moved:
            return labels


def components(edges: DataFrame, nodes: DataFrame, t: float = 0.0) -> DataFrame:
    """node, component (its smallest node), size; edges above ``t`` taken both ways."""
    spark = edges.sparkSession
    way = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    both = edges.filter(F.col("w") > t).select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("e"))  # edges may be costly: they are read once
    near = _cut(spark, both.select("e.i", "e.j").filter("i <> j").distinct())
    labels = _cut(spark, nodes.select(F.col("id").alias("node"), F.col("id").alias("label")))
    labels = smallest_labels(near, labels, lambda df: _cut(spark, df))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return lookup_by(labels, "label", sizes, hot_keys(labels, "label")).select("node", F.col("label").alias("component"), "size")


def _cut(spark, df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the session names; a temporary one is set only where none is and executors share this machine's disk."""
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="hyperpanel-"))
    return df.checkpoint()


def induced_subgraph(edges: DataFrame, selection: DataFrame, t: float = 0.0) -> DataFrame:
    """i, j, w (renumbered) of the selected vertices and their out-neighbours above ``t``.

    Vertices are numbered selected first (by ``pos``), then neighbours by id;
    weights are scaled by number of vertices / their sum.
    """
    vertices = subgraph_vertices(edges, selection, t)
    a, b = vertices.select(F.col("id").alias("i"), F.col("number").alias("ni")), vertices.select(F.col("id").alias("j"), F.col("number").alias("nj"))
    inner = edges.join(a, "i").join(b, "j")
    total = inner.agg(F.sum("w").alias("total")).crossJoin(vertices.agg(F.count(F.lit(1)).alias("n")))  # one row
    return inner.crossJoin(F.broadcast(total)).select(F.col("ni").alias("i"), F.col("nj").alias("j"), (F.col("w") * F.col("n") / F.col("total")).alias("w"))


def subgraph_vertices(edges: DataFrame, selection: DataFrame, t: float = 0.0) -> DataFrame:
    """id, number of the vertices of :func:`induced_subgraph`."""
    chosen = selection.select("id", F.col("pos").cast("long").alias("pos"))
    more = edges.filter(F.col("w") > t).join(chosen.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id")).distinct().join(chosen, "id", "left_anti")
    both = chosen.select("id", F.lit(0).alias("kind"), "pos").unionByName(more.select("id", F.lit(1).alias("kind"), F.col("id").alias("pos")))
    return both.select("id", (F.row_number().over(Window.orderBy("kind", "pos", "id")) - 1).cast("long").alias("number"))


def drop_edges_outside(edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges to ids in ``valid`` (id, number), with the target renumbered."""
    return edges.join(valid.select(F.col("id").alias("j"), "number"), "j").select("i", F.col("number").alias("j"), "w")


def times(vector: DataFrame, edges: DataFrame) -> DataFrame:
    """id, a: vector (id, a) times matrix."""
    return vector.join(edges, vector["id"] == edges["i"]).groupBy(F.col("j").alias("id")).agg(F.sum(F.col("a") * F.col("w")).alias("a"))


def power_iteration(vector: DataFrame, edges: DataFrame, iterations: int, eps: float = 0.0, cut_every: int = 8) -> DataFrame:
    """The distribution after ``iterations`` steps; entries below ``eps`` are dropped after each."""
    for k in range(iterations):
        vector = times(vector, edges)
        if eps:
            vector = vector.filter(F.col("a") >= eps)
        if (k + 1) % cut_every == 0:
            vector = _cut(edges.sparkSession, vector)
    return vector


def heterogeneity(edges: DataFrame, iterations: int = 5, eps: float = 1.0) -> DataFrame:
    """id, remaining: share of a mass n that starts at each vertex and survives steps that drop entries below ``eps``."""
    nodes = edges.select(F.col("i").alias("id")).unionByName(edges.select(F.col("j").alias("id"))).distinct()
    n = nodes.count()
    mass = nodes.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(float(n)).alias("a"))
    for _ in range(iterations):
        mass = mass.join(edges, mass["v"] == edges["i"]).groupBy("s", F.col("j").alias("v")).agg(F.sum(F.col("a") * F.col("w")).alias("a")).filter(F.col("a") >= eps)
    left = mass.groupBy("s").agg((F.sum("a") / n).alias("remaining"))
    return nodes.join(left, nodes["id"] == left["s"], "left").select("id", F.coalesce("remaining", F.lit(0.0)).alias("remaining"))


def expand(edges: DataFrame) -> DataFrame:
    """Two-step walks without return, rows normalised."""
    a, b = edges.select("i", F.col("j").alias("k"), F.col("w").alias("wa")), edges.select(F.col("i").alias("k"), "j", F.col("w").alias("wb"))
    two = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("w")).filter("i <> j AND w > 0")
    return row_normalised(two)


# --- random walks -----------------------------------------------------------


def walk_table(edges: DataFrame) -> DataFrame:
    """i, cum, to: each vertex's cumulated shares and targets as arrays, for lookups without a range join."""
    cdf = row_cdf(edges).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "hi"))).alias("r"))
    return cdf.select("i", F.transform("r", lambda x: x["hi"]).alias("cum"), F.transform("r", lambda x: x["j"]).alias("to"))


def start_walks(starts: DataFrame, walks: int) -> DataFrame:
    """walk (unique), start, at: ``walks`` for every id."""
    return starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("n")).select((F.col("start") * walks + F.col("n")).alias("walk"), "start", F.col("start").alias("at"))


def walk_step(walkers: DataFrame, table: DataFrame, seed: int, step: int) -> DataFrame:
    """Every walker moved once; those at a vertex without edges get at = null."""
    u = rng.uniform(seed, F.col("walk"), step)
    moved = walkers.join(table, walkers["at"] == table["i"], "left")
    place = F.array_position(F.transform("cum", lambda c: c > u), True)
    return moved.select("walk", "start", F.when(place > 0, F.try_element_at("to", place.cast("int"))).alias("at"))


def fixed_walks(edges: DataFrame, starts: DataFrame, walks: int, length: int, seed: int = 0, cut_every: int = 8) -> DataFrame:
    """walk, start, at: where each walk stands after length + 1 steps (null: disconnected)."""
    table, path = _stored(walk_table(edges), "walks")  # each step reads it
    if (graph := fetched_graph(table)) is not None:
        _dropped(path)
        return followed(graph, starts, walks, length, seed)
    walkers = start_walks(starts, walks)
    for k in range(length + 1):
        walkers = walk_step(walkers, table, seed, k)
        if (k + 1) % cut_every == 0:
            walkers = _cut(edges.sparkSession, walkers)
    return walkers


def absorbing_walks(edges: DataFrame, starts: DataFrame, stops: DataFrame, walks: int, length: int, seed: int = 0, cut_every: int = 8, other_than_start: bool = False) -> DataFrame:
    """walk, start, at: the first stop that each walk meets after at least one step, null if none within length + 1 steps."""
    table, path = _stored(walk_table(edges), "walks")  # each step reads it
    if (graph := fetched_graph(table)) is not None:
        _dropped(path)
        met = edges.sparkSession.createDataFrame(pa.table({"id": graph[0]}))  # others are never met
        marks = stops.select(F.col("id").cast("long").alias("id")).join(met, "id", "left_semi").distinct().toArrow()
        return followed(graph, starts, walks, length, seed, marks.column("id").to_numpy(), other_than_start)
    walkers = start_walks(starts, walks)
    ends = None
    stop = stops.select(F.col("id").alias("at"), F.lit(True).alias("stops"))
    for k in range(length + 1):
        walkers = walk_step(walkers, table, seed, k).filter("at IS NOT NULL").join(stop, "at", "left")
        if other_than_start:
            walkers = walkers.withColumn("stops", F.col("stops") & (F.col("at") != F.col("start")))
        walkers = walkers.select("walk", "start", "at", "stops")
        if (k + 1) % cut_every == 0:
            walkers = _cut(edges.sparkSession, walkers)
        done = walkers.filter("stops").select("walk", "start", "at")
        ends = done if ends is None else ends.unionByName(done)
        walkers = walkers.filter("stops IS NULL OR NOT stops").select("walk", "start", "at")
    every = start_walks(starts, walks).select("walk", "start")
    return every.join(ends.select("walk", "at"), "walk", "left")


def fetched_graph(table: DataFrame) -> tuple[np.ndarray, ...] | None:
    """Of a stored :func:`walk_table`: vertices in order, where each one's row begins in the cumulated shares and targets (as places of vertices); None beyond MOST_EDGES, or where shares don't rise."""
    n, edges = table.agg(F.count(F.lit(1)), F.sum(F.size("to"))).first()
    if n + (edges or 0) > MOST_EDGES:
        return None
    rows = table.filter("i IS NOT NULL").toArrow()
    i, cum, to = (rows.column(c).combine_chunks() for c in ("i", "cum", "to"))
    i, to_ids, lengths = i.cast(pa.int64()).to_numpy(), to.flatten().cast(pa.int64()).to_numpy(), pc.list_value_length(cum).to_numpy()
    ids = np.union1d(i, to_ids)
    order = np.argsort(i, kind="stable")
    degree = np.zeros(len(ids) + 1, np.int64)
    degree[np.searchsorted(ids, i) + 1] = lengths
    begins = np.cumsum(lengths) - lengths
    took = np.repeat(begins[order] - (np.cumsum(lengths[order]) - lengths[order]), lengths[order]) + np.arange(len(to_ids))
    first, shares = np.cumsum(degree), cum.flatten().to_numpy(zero_copy_only=False)[took]
    falls = ~(np.diff(shares, prepend=-np.inf) >= 0)
    falls[first[:-1][np.diff(first) > 0]] = False
    if falls.any() or np.isnan(shares).any():
        return None
    return ids, first, shares, np.searchsorted(ids, to_ids)[took].astype(np.int32)


def followed(graph: tuple[np.ndarray, ...], starts: DataFrame, walks: int, length: int, seed: int, stops: np.ndarray | None = None, other_than_start: bool = False) -> DataFrame:
    """The walks of :func:`fixed_walks`, or, with ``stops``, of :func:`absorbing_walks`, each followed to its end by the task that has its start."""
    spark = starts.sparkSession
    every = spark.sparkContext.broadcast((*graph, stops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, cum, to, marks = every.value
        ends = None if marks is None else np.zeros(len(ids), bool)
        if ends is not None:
            ends[np.searchsorted(ids, marks)] = True
        step = max(1, WALKS_AT_ONCE // max(1, walks))
        for batch in batches:
            own = batch.column("id").to_numpy()
            for s in range(0, len(own), step):
                start = np.repeat(own[s : s + step], walks)
                walk = start * walks + np.tile(np.arange(walks), len(own[s : s + step]))
                at = np.clip(np.searchsorted(ids, start), 0, max(0, len(ids) - 1))
                at = np.where(ids[at] == start, at, -1) if len(ids) else np.full(len(start), -1)
                met = np.full(len(start), -1)
                open_ = np.flatnonzero(at >= 0)
                for k in range(length + 1):
                    at[open_] = _moved(at[open_], first, cum, to, rng.uniform_of(seed, walk[open_], k))
                    open_ = open_[at[open_] >= 0]
                    if ends is not None:
                        stopped = ends[at[open_]]
                        if other_than_start:
                            stopped &= ids[at[open_]] != start[open_]
                        met[open_[stopped]] = at[open_[stopped]]
                        open_ = open_[~stopped]
                met = at if ends is None else met
                where = pa.array(ids[np.maximum(met, 0)] if len(ids) else start, mask=met < 0)
                yield pa.RecordBatch.from_arrays([pa.array(walk), pa.array(start), where], names=["walk", "start", "at"])

    dealt = starts.select(F.col("id").cast("long").alias("id")).filter("id IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "walk long, start long, at long")


def _moved(at: np.ndarray, first: np.ndarray, cum: np.ndarray, to: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The targets of walks at vertices: the first whose cumulated share is above ``u``; -1 if there is none."""
    low, last = first[at], first[at + 1]
    high = last.copy()
    while len(look := np.flatnonzero(low < high)):
        middle = (low[look] + high[look]) // 2
        above = cum[middle] > u[look]
        high[look] = np.where(above, middle, high[look])
        low[look] = np.where(above, low[look], middle + 1)
    out = np.full(len(at), -1)
    found = low < last
    out[found] = to[low[found]]
    return out


def visits(walkers: DataFrame) -> DataFrame:
    """id, n: walks that ended at each vertex."""
    return walkers.filter("at IS NOT NULL").groupBy(F.col("at").alias("id")).agg(F.count(F.lit(1)).alias("n"))
