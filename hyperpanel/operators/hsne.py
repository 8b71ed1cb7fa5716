"""Hierarchy of landmarks: selection, areas of influence, transitions, and queries over them.

A scale is four tables: landmarks (lm, orig_id, prev_id, weight), transition
(i, j, w), aoi (prev, lm, p) and its number; :class:`Hierarchy` holds a list.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from . import graphs
from .similarity import hsne_graph, row_normalised


@dataclass(frozen=True)
class Parameters:
    seed: int = 0
    neighbours: int = 30
    walks: int = 10
    walk_length: int = 10
    threshold: float = 1.5
    hard_cut: bool = False
    hard_cut_share: float = 0.1
    monte_carlo: bool = True
    reduction: float = 0.1
    outlier_jumps: int = 10
    walks_per_landmark: int = 100
    prune: float = 1.5
    max_jumps: int = 100


@dataclass
class Scale:
    landmarks: DataFrame
    transition: DataFrame
    aoi: DataFrame | None = None


@dataclass
class Hierarchy:
    scales: list[Scale] = field(default_factory=list)
    parameters: Parameters = Parameters()

    @property
    def top(self) -> int:
        return len(self.scales) - 1


def first_scale(transition: DataFrame) -> Scale:
    """All points as landmarks of weight 1."""
    ids = transition.select(F.col("i").alias("lm")).distinct()
    return Scale(ids.select("lm", F.col("lm").alias("orig_id"), F.col("lm").alias("prev_id"), F.lit(1.0).alias("weight")), transition)


def from_points(points: DataFrame, parameters: Parameters = Parameters()) -> Hierarchy:
    return Hierarchy([first_scale(hsne_graph(points, parameters.neighbours))], parameters)


def from_similarities(transition: DataFrame, parameters: Parameters = Parameters()) -> Hierarchy:
    """A hierarchy over given similarities (i, j, w; negative ones are an error), rows normalised; vertices that are only targets are points too."""
    if transition.filter("w < 0").limit(1).count():
        raise ValueError("similarities are not negative")
    ids = transition.select("i").unionByName(transition.select(F.col("j").alias("i"))).distinct().select(F.col("i").alias("lm"))
    points = ids.select("lm", F.col("lm").alias("orig_id"), F.col("lm").alias("prev_id"), F.lit(1.0).alias("weight"))
    return Hierarchy([Scale(points, row_normalised(transition.select("i", "j", "w")))], parameters)


def statistics(h: Hierarchy) -> DataFrame:
    """scale, landmarks, transitions, influences, weight: sizes of all scales and their landmarks' total weight."""
    out = None
    for s, scale in enumerate(h.scales):
        own = scale.landmarks.agg(F.count(F.lit(1)).alias("landmarks"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
        moves = scale.transition.agg(F.count(F.lit(1)).alias("transitions"))
        areas_ = (scale.aoi if scale.aoi is not None else scale.landmarks.limit(0)).agg(F.count(F.lit(1)).alias("influences"))
        row = own.crossJoin(moves).crossJoin(areas_).select(F.lit(s).alias("scale"), "landmarks", "transitions", "influences", "weight")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def order_statistic(counts: DataFrame, share: float) -> DataFrame:
    """cut: the value at place floor((n - 1)(1 - share)) of the sorted counts."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))  # counts of visits: few different ones
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.select("n", F.sum("rows").over(upto).alias("upto"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    place = F.floor((F.col("all") - 1) * (1 - share))
    return placed.filter(F.col("upto") > place).agg(F.min("n").alias("cut"))


def percentile_cut(counts: DataFrame, share: float) -> DataFrame:
    """id, n strictly above the order statistic."""
    return counts.crossJoin(F.broadcast(order_statistic(counts, share))).filter(F.col("n") > F.col("cut")).select("id", "n")


def landmarks_by_visits(transition: DataFrame, nodes: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """id, n of vertices that random walks end at more often than the threshold."""
    n = graphs.visits(graphs.fixed_walks(transition, nodes, p.walks, p.walk_length, p.seed))
    counts = nodes.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return percentile_cut(counts, p.hard_cut_share) if p.hard_cut else counts.filter(F.col("n") > int(p.walks * p.threshold))


def landmarks_at_random(transition: DataFrame, nodes: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """id: a fixed share of the vertices without replacement; each draw may first walk away from outliers."""
    n = nodes.count()
    drawn = nodes.withColumn("u", rng.uniform(p.seed, F.col("id"))).orderBy("u", "id").limit(max(1, int(n * p.reduction))).select("id")
    if not p.outlier_jumps:
        return drawn
    return graphs.fixed_walks(transition, drawn, 1, p.outlier_jumps, p.seed + 1).filter("at IS NOT NULL").select(F.col("at").alias("id")).distinct()


def areas(transition: DataFrame, nodes: DataFrame, landmarks: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """prev, lm, hits, p: how often walks from each vertex are absorbed by each landmark."""
    ends = graphs.absorbing_walks(transition, nodes, landmarks, p.walks_per_landmark, p.max_jumps, p.seed)
    return ends.filter("at IS NOT NULL").groupBy(F.col("start").alias("prev"), F.col("at").alias("lm")).agg(F.count(F.lit(1)).alias("hits")).withColumn("p", F.col("hits") / float(p.walks_per_landmark))


def exact_areas(transition: DataFrame, nodes: DataFrame, landmarks: DataFrame, jumps: int) -> DataFrame:
    """prev, lm, p: absorption probabilities within ``jumps`` steps, without sampling."""
    stop = landmarks.select(F.col("id").alias("at"), F.lit(True).alias("stops"))
    mass = nodes.select(F.col("id").alias("prev"), F.col("id").alias("at"), F.lit(1.0).alias("a"))
    out = None
    for k in range(jumps):
        mass = mass.join(transition, mass["at"] == transition["i"]).groupBy("prev", F.col("j").alias("at")).agg(F.sum(F.col("a") * F.col("w")).alias("a"))
        met = mass.join(stop, "at", "left")
        got = met.filter("stops").select("prev", F.col("at").alias("lm"), F.col("a").alias("p"))
        out = got if out is None else out.unionByName(got)
        mass = met.filter("stops IS NULL").select("prev", "at", "a")
        if (k + 1) % 6 == 0:
            mass, out = graphs._cut(transition.sparkSession, mass), graphs._cut(transition.sparkSession, out)
    return out.groupBy("prev", "lm").agg(F.sum("p").alias("p"))


def overlap_transition(aoi: DataFrame, weights: DataFrame, prune: float, column: str = "hits") -> DataFrame:
    """i, j, w: overlaps of areas of influence, pruned before the join, rows normalised. weights: prev, weight."""
    kept = aoi.filter(F.col(column) > prune).select("prev", "lm", F.col(column).alias("h"))
    a, b = kept.join(weights, "prev").select("prev", F.col("lm").alias("i"), (F.col("h") * F.col("weight")).alias("x")), kept.select("prev", F.col("lm").alias("j"), F.col("h").alias("y"))
    both = a.join(b, "prev").filter("i <> j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("w"))
    return row_normalised(both)


def pruned_transition(transition: DataFrame, least: float = 0.001) -> DataFrame:
    """Entries above ``least``, rows normalised again."""
    return row_normalised(transition.filter(F.col("w") > least))


def landmark_weights(aoi: DataFrame, weights: DataFrame) -> DataFrame:
    """lm, weight: the weight that flows to each landmark."""
    return aoi.join(weights, "prev").groupBy("lm").agg(F.sum(F.col("p") * F.col("weight")).alias("weight"))


def add_scale(h: Hierarchy, out_of_core: bool = False) -> Hierarchy:
    """The hierarchy with one scale more; landmarks keep the ids of the points they stand for."""
    p, below = h.parameters, h.scales[-1]
    spark = below.transition.sparkSession
    nodes = below.landmarks.select(F.col("lm").alias("id"))
    chosen = landmarks_by_visits(below.transition, nodes, p) if p.monte_carlo else landmarks_at_random(below.transition, nodes, p)
    chosen = graphs._cut(spark, chosen.select("id"))
    aoi = graphs._cut(spark, areas(below.transition, nodes, chosen, p))
    weights = below.landmarks.select(F.col("lm").alias("prev"), "weight")
    if out_of_core:
        moved = pruned_transition(overlap_transition(aoi, weights, 0.01 * p.prune, "p"))
    else:
        moved = overlap_transition(aoi, weights, p.prune)
    own = landmark_weights(aoi, weights)
    names = below.landmarks.select("lm", "orig_id")
    table = chosen.select(F.col("id").alias("lm")).join(own, "lm", "left").join(names, "lm").select("lm", "orig_id", F.col("lm").alias("prev_id"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return Hierarchy([*h.scales, Scale(graphs._cut(spark, table), graphs._cut(spark, moved), aoi.select("prev", "lm", "p"))], p)


def sparsity_of_scale(aoi: DataFrame, transition: DataFrame, n_prev: int, n: int) -> DataFrame:
    """One row: sparsity of both matrices, and the share of entries above 0.01 and 0.001."""
    a = aoi.agg(F.count(F.lit(1)).alias("a"), F.count(F.when(F.col("p") > 0.01, 1)).alias("ae"))
    t = transition.agg(F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("w") > 0.001, 1)).alias("te"))
    share = lambda c, cells: 1 - F.col(c) / float(max(1, cells))
    return a.crossJoin(t).select(share("a", n_prev * n).alias("aoi_sparsity"), share("t", n * n).alias("transition_sparsity"), share("ae", n_prev * n).alias("aoi_effective"), share("te", n * n).alias("transition_effective"))


def memory_estimate(edges: DataFrame) -> DataFrame:
    """MB of a sparse matrix at 8 bytes an entry."""
    return edges.agg((F.count(F.lit(1)) * 8 / 1024.0 / 1024.0).alias("mb"))


# --- influence --------------------------------------------------------------


def influenced_below(aoi: DataFrame, selection: DataFrame) -> DataFrame:
    """id, influence: landmarks one scale down that the selected ones (id) influence."""
    return aoi.join(selection.select(F.col("id").alias("lm")), "lm", "left_semi").groupBy(F.col("prev").alias("id")).agg(F.sum("p").alias("influence")).filter("influence > 0")


def influencing_above(aoi: DataFrame, selection: DataFrame) -> DataFrame:
    """id, influence: share of each upper landmark's area that the selected lower ones (id) make up."""
    marked = aoi.join(selection.select(F.col("id").alias("prev"), F.lit(True).alias("chosen")), "prev", "left")
    own = F.sum(F.when(F.col("chosen"), F.col("p")).otherwise(0.0))
    return marked.groupBy(F.col("lm").alias("id")).agg((own / F.sum("p")).alias("influence")).filter("influence > 0")


def interpolation_weights(h: Hierarchy, scale: int | None = None) -> DataFrame:
    """id, lm, p: influence of the landmarks of a scale on every point, the product of the areas below."""
    scale = h.top if scale is None else scale
    out = h.scales[0].landmarks.select(F.col("lm").alias("id"), "lm", F.lit(1.0).alias("p"))
    for s in range(1, scale + 1):
        aoi = h.scales[s].aoi.select(F.col("prev"), F.col("lm").alias("up"), F.col("p").alias("q"))
        # areas grow with the data and compress well: they are not broadcast by their size on disk
        out = out.join(aoi.hint("merge"), out["lm"] == aoi["prev"]).groupBy("id", F.col("up").alias("lm")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return out


def influence_on(h: Hierarchy, point: int, least: float = 0.0, normalised: bool = True) -> DataFrame:
    """scale, lm, p of the landmarks of all scales that influence one point."""
    out = None
    for s in range(len(h.scales)):
        own = interpolation_weights(h, s).filter(F.col("id") == point).filter(F.col("p") > least).select(F.lit(s).alias("scale"), "lm", "p")
        out = own if out is None else out.unionByName(own)
    return out.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("scale"))) if normalised else out


def area_of_influence(h: Hierarchy, scale: int, selection: DataFrame) -> DataFrame:
    """id, p: influence of the selected landmarks (id) on the points, exactly."""
    weights = interpolation_weights(h, scale)
    return weights.join(selection.select(F.col("id").alias("lm")), "lm", "left_semi").groupBy("id").agg(F.sum("p").alias("p"))


def area_top_down(h: Hierarchy, scale: int, selection: DataFrame, least: float = 0.3) -> DataFrame:
    """id of the points reached by keeping, at each step down, what is influenced above ``least``."""
    chosen = selection.select("id")
    for s in range(scale, 0, -1):
        chosen = influenced_below(h.scales[s].aoi, chosen).filter(F.col("influence") > least).select("id")
    return chosen


def over_area(h: Hierarchy, scale: int, selection: DataFrame, by):
    """``by(area)`` of the area of influence: the hook for callers' own aggregates."""
    return by(area_of_influence(h, scale, selection))


def dominant(weights: DataFrame) -> DataFrame:
    """id, lm, p: each point's most influential landmark; ties by id."""
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "lm"))
    return weights.withColumn("rk", best).filter("rk = 1").select("id", "lm", "p")


# --- clusters ---------------------------------------------------------------


def flow_between(aoi: DataFrame, weights: DataFrame, upper: DataFrame, lower: DataFrame) -> DataFrame:
    """source, target, value: weight that flows from lower clusters to upper ones; 0 is unclustered.

    upper and lower: cluster_id, lm. weights: prev, weight.
    """
    up, low = upper.select("lm", (F.col("cluster_id") + 1).alias("u")), lower.select(F.col("lm").alias("prev"), (F.col("cluster_id") + 1).alias("l"))
    rows = aoi.join(weights, "prev").join(up, "lm", "left").join(low, "prev", "left")
    return rows.groupBy(F.coalesce("l", F.lit(0)).alias("source"), F.coalesce("u", F.lit(0)).alias("target")).agg(F.sum(F.col("p") * F.col("weight")).alias("value"))


def free_cluster_id(clusters: DataFrame, scale: int) -> int:
    """Smallest id not in use at a scale."""
    used = {r[0] for r in clusters.filter(F.col("scale") == scale).select("cluster_id").collect()}  # clusters are made by hand
    return next(k for k in range(len(used) + 1) if k not in used)


def checked_cluster(clusters: DataFrame, scale: int, cluster_id: int, parent: int | None, top: int) -> None:
    """Raise unless a cluster may be added: a root at the top only, an id not in use."""
    if (parent is None) != (scale == top):
        raise ValueError("exactly the clusters of the top scale are roots")
    if clusters.filter((F.col("scale") == scale) & (F.col("cluster_id") == cluster_id)).limit(1).count():
        raise ValueError("cluster id in use")


def add_cluster(clusters: DataFrame, scale: int, cluster_id: int, parent: int | None, top: int) -> DataFrame:
    """clusters (scale, cluster_id, parent_id, notes or other columns) with one more, others null; see :func:`checked_cluster`."""
    checked_cluster(clusters, scale, cluster_id, parent, top)
    new = clusters.sparkSession.createDataFrame([(scale, cluster_id, parent)], "scale int, cluster_id int, parent_id int")
    kept = new.select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in clusters.schema))
    return clusters.unionByName(kept)


def has_cluster(clusters: DataFrame, scale: int, cluster_id: int) -> bool:
    return bool(clusters.filter((F.col("scale") == scale) & (F.col("cluster_id") == cluster_id)).limit(1).count())


def get_cluster(clusters: DataFrame, scale: int, cluster_id: int) -> DataFrame:
    """The row of a cluster; without it, an error."""
    if not has_cluster(clusters, scale, cluster_id):
        raise KeyError(f"no cluster {cluster_id} at scale {scale}")
    return clusters.filter((F.col("scale") == scale) & (F.col("cluster_id") == cluster_id))


def remove_cluster(clusters: DataFrame, scale: int, cluster_id: int) -> DataFrame:
    """clusters without one that is there; its children keep their parent's id."""
    get_cluster(clusters, scale, cluster_id)
    return clusters.filter(~((F.col("scale") == scale) & (F.col("cluster_id") == cluster_id)))


def cluster_parents(aoi: DataFrame, members: DataFrame, upper: DataFrame) -> DataFrame:
    """cluster_id, best (upper cluster of the largest influence, -1: unclustered). members, upper: cluster_id, lm."""
    own = members.select("cluster_id", F.col("lm").alias("prev"))
    up = upper.select(F.col("cluster_id").alias("u"), "lm")
    mass = own.join(aoi, "prev").join(up, "lm", "left").groupBy("cluster_id", F.coalesce("u", F.lit(-1)).alias("best")).agg(F.sum("p").alias("m"))
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("m"), "best"))
    return mass.withColumn("rk", first).filter("rk = 1").select("cluster_id", "best")


def consistent(aoi: DataFrame, clusters: DataFrame, members: DataFrame, upper: DataFrame) -> DataFrame:
    """cluster_id, ok: is the upper cluster of the largest influence the parent."""
    best = cluster_parents(aoi, members, upper)
    return clusters.join(best, "cluster_id", "left").select("cluster_id", F.coalesce(F.col("best") == F.col("parent_id"), F.lit(False)).alias("ok"))


def point_clusters(h: Hierarchy, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """id, scale, cluster_id, influence of every point.

    From the top down, a point goes into the child cluster of its present one
    with the largest influence, if that exceeds the unclustered share; without
    any, it is (top, -1, 1). clusters: scale, cluster_id, parent_id; members:
    scale, cluster_id, lm.
    """
    points = h.scales[0].landmarks.select(F.col("lm").alias("id"))
    state = points.select("id", F.lit(h.top).alias("scale"), F.lit(-1).alias("cluster_id"), F.lit(1.0).alias("influence"), F.lit(True).alias("open"))
    for s in range(h.top, -1, -1):
        weights = interpolation_weights(h, s)
        own = clusters.filter(F.col("scale") == s).select(F.col("cluster_id").alias("c"), F.coalesce("parent_id", F.lit(-1)).alias("parent"))
        of = members.filter(F.col("scale") == s).select(F.col("cluster_id").alias("c"), "lm").join(own, "c")
        mass = weights.join(of, "lm", "left").join(state.filter("open").select("id", F.col("cluster_id").alias("now")), "id")
        inside = F.when(F.col("parent") == F.col("now"), F.col("c"))
        mass = mass.groupBy("id", inside.alias("c")).agg(F.sum("p").alias("m"))
        free = F.sum(F.when(F.col("c").isNull(), F.col("m")).otherwise(0.0)).over(Window.partitionBy("id"))
        best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("c").isNull(), F.desc("m"), "c"))
        found = mass.withColumn("free", free).withColumn("rk", best).filter("rk = 1 AND c IS NOT NULL AND m > free").select("id", F.col("c").cast("int").alias("c"), "m")
        state = state.join(found, "id", "left").select(
            "id", F.when(F.col("c").isNotNull(), F.lit(s)).otherwise(F.col("scale")).alias("scale"), F.coalesce("c", "cluster_id").alias("cluster_id"),
            F.coalesce("m", "influence").alias("influence"), (F.col("open") & F.col("c").isNotNull()).alias("open"),
        )
    return state.select("id", "scale", "cluster_id", "influence")
