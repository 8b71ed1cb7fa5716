"""Queries over sampled data, walks between landmarks, and volumes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import graphs as G
from ..operators import hsne as H
from ..operators import session as S
from ..sources import tables as T
from ..sources.text_formats import columns_to_zscores
from .analysis_queries import _CHAIN, hierarchy
from .graph_queries import _AOI, _CDF, _STOPS, _T, AT, _aoi, _ones, _stops
from .panel_queries import r
from .registry import edges_sql, edges, panel, query, read, rounded, transition

_U = rng.uniform_sql


def _normal(seed: int, key: str) -> str:
    return f"sqrt(-2.0 * ln(greatest({_U(seed, key, '1')}, 1e-12))) * cos(2 * {math.pi} * {_U(seed, key, '2')})"


@query("gaussian_spheres", f"""WITH p AS (SELECT unnest(range(600)) AS id), q AS (SELECT id, CAST(id // 200 AS INT) AS label FROM p),
 v AS (SELECT id, label, {_U(0, '(label * 2 + 0)', '7')} * 3 AS c0, {_U(0, '(label * 2 + 1)', '7')} * 3 AS c1, {_normal(1, 'id')} AS v0, {_normal(2, 'id')} AS v1, {_U(0, 'id', '3')} AS u FROM q)
 SELECT id, label, {r('c0 + v0 / sqrt(v0 * v0 + v1 * v1) * u', 'x')}, {r('c1 + v1 / sqrt(v0 * v0 + v1 * v1) * u', 'y')} FROM v""")
def gaussian_spheres(spark, d):
    p = T.spheres(spark, 3, 200, 2)
    return rounded(p.select("id", "label", F.col("features")[0].alias("x"), F.col("features")[1].alias("y")), "x", "y")


@query("memory_estimate", f"WITH {edges_sql()} SELECT {r('count(*) * 8 / 1024.0 / 1024.0', 'mb')} FROM edges")
def memory_estimate(spark, d):
    return rounded(H.memory_estimate(edges(spark, d)), "mb")


_WALK = _U(2, "w.walk", "w.step")


@query("landmark_walks", f"""WITH RECURSIVE {_T}, {_CDF}, {_STOPS}, w AS (SELECT id * 4 + n AS walk, id AS start, id AS {AT}, 0 AS step, false AS done FROM stops, (SELECT unnest(range(4)) AS n)
 UNION ALL SELECT w.walk, w.start, c.j, w.step + 1, s.id IS NOT NULL AND c.j <> w.start FROM w JOIN cdf c ON c.i = w.{AT} AND {_WALK} >= c.lo AND {_WALK} < c.hi LEFT JOIN stops s ON s.id = c.j WHERE w.step < 7 AND NOT w.done),
 ends AS (SELECT walk, {AT} FROM w WHERE done) SELECT walk, start, ends.{AT} FROM (SELECT walk, start FROM w WHERE step = 0) LEFT JOIN ends USING (walk)""")
def landmark_walks(spark, d):
    stops = _stops(spark, d)
    return G.absorbing_walks(transition(spark, d), stops, stops, 4, 6, seed=2, other_than_start=True)


@query("transition_out_of_core", f"""WITH RECURSIVE {_AOI}, o AS (SELECT a.lm AS i, b.lm AS j, sum(a.p * b.p) AS w FROM aoi a JOIN aoi b ON a.prev = b.prev AND a.lm <> b.lm WHERE a.p > 0.015 AND b.p > 0.015 GROUP BY 1, 2),
 n AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM o) SELECT i, j, {r('w / sum(w) OVER (PARTITION BY i)', 'w')} FROM n WHERE w > 0.01""")
def transition_out_of_core(spark, d):
    return rounded(H.pruned_transition(H.overlap_transition(_aoi(spark, d), _ones(spark, d), 0.015, "p"), 0.01), "w")


@query("influence_table", f"WITH {_CHAIN}, a AS (SELECT id, sum(p) AS p FROM c2 WHERE lm IN (0, 100) GROUP BY id) SELECT pts.id % 10 AS x, pts.id % 7 AS y, pts.id AS z, {r('coalesce(p, 0)', 'aoi')} FROM pts LEFT JOIN a ON a.id = pts.id")
def influence_table(spark, d):
    h = hierarchy(spark, d)
    voxels = panel(spark, d).select("id", (F.col("id") % 10).alias("x"), (F.col("id") % 7).alias("y"), F.col("id").alias("z"))
    return rounded(S.influence_table(h, 2, h.scales[2].landmarks.filter("lm IN (0, 100)").select(F.col("lm").alias("id")), voxels), "aoi")


@query("columns_to_zscores", f"WITH c AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS id, CAST(n_nationkey * n_nationkey AS DOUBLE) AS x FROM nation) SELECT id, CAST(k AS INT) AS dim, {r('(x - avg(x) OVER (PARTITION BY k)) / sqrt(avg(x * x) OVER (PARTITION BY k) - pow(avg(x) OVER (PARTITION BY k), 2) + 1e-6)', 'x')} FROM c")
def zscored_columns(spark, d):
    from ..schema import to_cells

    lines = read(spark, d, "nation").groupBy(F.col("n_regionkey").alias("column")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda n: (n * n).cast("string"))).alias("value"))
    return rounded(to_cells(columns_to_zscores(lines)), "x")


@query("hsne_session")
def hsne_session(spark, d):
    """A hierarchy of two scales, its top view laid out."""
    h = S.build(panel(spark, d), H.Parameters(neighbours=12, walks=6, walk_length=5, walks_per_landmark=20, max_jumps=20), scales=2)
    y = S.embed_view(h, iterations=40)
    return rounded(y.select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1", digits=4)
