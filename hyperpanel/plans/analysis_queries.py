"""Queries over embeddings, hierarchies, clusters, sessions and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import analysis as A
from ..operators import embedding as E
from ..operators import hsne as H
from ..operators import session as S
from ..operators import similarity as M
from ..schema import to_cells
from .graph_queries import _MEMBER, membership
from .panel_queries import r
from .registry import CELLS, DRAWING, PTS, drawing, edges, edges_sql, knn_sql, layout, panel, query, read, rounded, transition_sql, transition

# --- linear methods, k-means, evaluation -------------------------------------

_LOW = "low AS (SELECT l_orderkey AS id, l_quantity AS x0, l_extendedprice / 1000 AS x1, l_discount AS x2, l_tax AS x3, l_linenumber AS w, l_returnflag AS k FROM lineitem)"


def low(spark, d):
    """Four dimensions of the line items."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.array("l_quantity", F.col("l_extendedprice") / 1000, "l_discount", "l_tax").alias("features"), F.col("l_linenumber").cast("double").alias("weight"), F.col("l_returnflag").alias("k"))


def _cov(weight: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {a} AS a, {b} AS b, {r(f'sum({weight} * x{a} * x{b}) / sum({weight}) - sum({weight} * x{a}) / sum({weight}) * (sum({weight} * x{b}) / sum({weight}))', 'c', 5)} FROM low" for a in range(4) for b in range(4)
    )


@query("covariance", f"WITH {_LOW} {_cov('1.0')}")
def covariance(spark, d):
    return rounded(A.covariance(low(spark, d)), "c", digits=5)


@query("covariance_all", f"WITH {CELLS} SELECT p.dim AS a, q.dim AS b, {r('covar_pop(p.x, q.x)', 'c')} FROM cells p JOIN cells q ON p.id = q.id GROUP BY 1, 2")
def covariance_all(spark, d):
    """Of all dimensions of the embeddings."""
    return rounded(A.covariance(panel(spark, d)), "c")


@query("weighted_covariance", f"WITH {_LOW} {_cov('w')}")
def weighted_covariance(spark, d):
    return rounded(A.covariance(low(spark, d), "weight"), "c", digits=5)


@query("local_covariance", f"WITH {edges_sql()}, n AS (SELECT i, w, f FROM edges JOIN pts ON pts.id = edges.j), a AS (SELECT unnest(range(64)) AS a), b AS (SELECT unnest(range(64)) AS b) SELECT i, CAST(a AS INT) AS a, CAST(b AS INT) AS b, {r('sum(w * f[a + 1] * f[b + 1]) / sum(w) - sum(w * f[a + 1]) * sum(w * f[b + 1]) / (sum(w) * sum(w))', 'c')} FROM n, a, b GROUP BY i, a, b")
def local_covariance(spark, d):
    return rounded(A.local_covariance(panel(spark, d), edges(spark, d)), "c")


@query("pca")
def pca(spark, d):
    return rounded(A.pca(low(spark, d)).select("axis", "variance", F.posexplode("direction").alias("dim", "x")), "variance", "x", digits=4)


@query("intrinsic_dim")
def intrinsic_dim(spark, d):
    return rounded(A.intrinsic_dimension(panel(spark, d), edges(spark, d, 10)), "dimension")


_TWO = "two AS (SELECT l_quantity AS x, l_discount AS y, l_returnflag AS k FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query("lda_2d", f"""WITH {_TWO}, s AS (SELECT k, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS cxx, covar_pop(x, y) AS cxy, covar_pop(y, y) AS cyy FROM two GROUP BY k),
 c AS (SELECT sum(cxx) AS a, sum(cxy) AS b, sum(cyy) AS c, sum(CASE k WHEN 'A' THEN mx ELSE -mx END) AS dx, sum(CASE k WHEN 'A' THEN my ELSE -my END) AS dy FROM s)
 SELECT 0 AS dim, {r('(c * dx - b * dy) / (a * c - b * b)', 'v')} FROM c UNION ALL SELECT 1, {r('(a * dy - b * dx) / (a * c - b * b)', 'v')} FROM c""")
def lda_2d(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.array("l_quantity", "l_discount").alias("features"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("k"))
    return rounded(A.lda_direction(rows, "k", 1, 2), "v")


_CENTRES = "cen AS (SELECT id AS c, f FROM pts WHERE id < 8)"
_ASSIGN = f"{PTS}, {_CENTRES}, a AS (SELECT * FROM (SELECT id, pts.f, c, pow(list_distance(pts.f, cen.f), 2) AS d2, row_number() OVER (PARTITION BY id ORDER BY list_distance(pts.f, cen.f), c) AS rk FROM pts, cen) WHERE rk = 1)"


def _centres(spark, d):
    return panel(spark, d).filter("id < 8").select(F.col("id").cast("int").alias("c"), F.col("features").alias("centre"))


@query("kmeans_assign", f"WITH {_ASSIGN} SELECT id, CAST(c AS INT) AS c, {r('d2', 'd2')} FROM a")
def kmeans_assign(spark, d):
    return rounded(A.assign(panel(spark, d), _centres(spark, d)).select("id", "c", "d2"), "d2")


@query("kmeans_step", f"WITH {_ASSIGN}, x AS (SELECT c, generate_subscripts(f, 1) - 1 AS dim, unnest(f) AS x FROM a) SELECT CAST(c AS INT) AS c, CAST(dim AS INT) AS dim, {r('avg(x)', 'x')} FROM x GROUP BY c, dim")
def kmeans_step(spark, d):
    return rounded(A.kmeans_step(panel(spark, d), _centres(spark, d)).select("c", F.posexplode("centre").alias("dim", "x")), "x")


@query("kmeans_full")
def kmeans_full(spark, d):
    return rounded(A.kmeans(panel(spark, d), 10, 5).select("c", F.posexplode("centre").alias("dim", "x")), "x")


@query("precision_recall", f"""WITH {PTS}, {knn_sql(15, 'hd')}, {DRAWING}, e AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY (a.y0-b.y0)*(a.y0-b.y0)+(a.y1-b.y1)*(a.y1-b.y1), b.id) AS rk FROM drawing a JOIN drawing b ON a.id <> b.id),
 h AS (SELECT e.i, e.rk, sum(CASE WHEN hd.j IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.i ORDER BY e.rk) AS hits FROM e LEFT JOIN hd ON hd.i = e.i AND hd.j = e.j WHERE e.rk <= 15)
 SELECT CAST(rk AS INT) AS k, {r('avg(hits / rk)', 'precision')}, {r('avg(hits / 15.0)', 'recall')} FROM h GROUP BY rk""")
def precision_recall(spark, d):
    return rounded(A.precision_recall(panel(spark, d), drawing(spark, d), 15), "precision", "recall")


@query("interpolate", f"WITH {edges_sql()}, {DRAWING} SELECT i AS id, {r('sum(w * y0) / sum(w)', 'y0')}, {r('sum(w * y1) / sum(w)', 'y1')} FROM edges JOIN drawing ON drawing.id = edges.j GROUP BY i")
def interpolate(spark, d):
    out = A.interpolate(drawing(spark, d), edges(spark, d).select(F.col("i").alias("id"), F.col("j").alias("lm"), F.col("w").alias("p")))
    return rounded(out.select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1")


_EQ = "b AS (SELECT min(y0) AS a0, max(y0) - min(y0) AS s0, min(y1) AS a1, max(y1) - min(y1) AS s1 FROM drawing)"


@query("equalizer_step", f"WITH {DRAWING}, {_EQ} SELECT id, {r('y0 + ((y1 - a1) / s1 - (y0 - a0) / s0) * 0.02 * s0', 'y0')}, {r('y1', 'y1')} FROM drawing, b")
def equalizer_step(spark, d):
    y = drawing(spark, d)
    none = y.select("id", F.lit(0.0).alias("delta"))
    return rounded(A.equaliser_step(y, y, none, master_dim=1, slave_dim=0).select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1")


@query("equalizer_step_linked", f"WITH {edges_sql()}, {DRAWING}, {_EQ}, m AS (SELECT i AS id, sum(w * (y0 - a0) / s0) / sum(w) AS m FROM edges JOIN drawing ON drawing.id = edges.j, b GROUP BY i) SELECT id, {r('y0 + (m - (y0 - a0) / s0) * 0.02 * s0', 'y0')} FROM drawing JOIN m USING (id), b")
def equalizer_step_linked(spark, d):
    y = drawing(spark, d)
    links = edges(spark, d).select(F.col("i").alias("id"), F.col("j").alias("master_id"), "w")
    return rounded(A.equaliser_step(y, y, y.select("id", F.lit(0.0).alias("delta")), connections=links).select("id", F.col("y")[0].alias("y0")), "y0")


# --- optimiser steps ---------------------------------------------------------

_JE = f"{edges_sql()}, {DRAWING}, je AS (SELECT i, j, w / (SELECT sum(w) FROM edges) AS w FROM edges)"
_REP = "rep AS (SELECT a.id, sum(q) AS z, sum(q*q*(a.y0-b.y0)) AS f0, sum(q*q*(a.y1-b.y1)) AS f1 FROM drawing a JOIN drawing b ON a.id <> b.id, LATERAL (SELECT 1 / (1 + (a.y0-b.y0)*(a.y0-b.y0) + (a.y1-b.y1)*(a.y1-b.y1)) AS q) GROUP BY a.id)"
_ATT = "att AS (SELECT i AS id, sum(w*q*(a.y0-b.y0)) AS a0, sum(w*q*(a.y1-b.y1)) AS a1 FROM je JOIN drawing a ON a.id = i JOIN drawing b ON b.id = j, LATERAL (SELECT 1 / (1 + (a.y0-b.y0)*(a.y0-b.y0) + (a.y1-b.y1)*(a.y1-b.y1)) AS q) GROUP BY i)"
_GRAD = f"{_JE}, {_REP}, {_ATT}, grad AS (SELECT id, 4 * (4 * coalesce(a0, 0) - f0 / (SELECT sum(z) FROM rep)) AS g0, 4 * (4 * coalesce(a1, 0) - f1 / (SELECT sum(z) FROM rep)) AS g1 FROM rep LEFT JOIN att USING (id))"


def _je(spark, d):
    e = E._stored(edges(spark, d), "edges")[0]  # they are read twice
    return e.crossJoin(F.broadcast(e.agg(F.sum("w").alias("total")))).select("i", "j", (F.col("w") / F.col("total")).alias("w"))


def _g(grad):
    return rounded(grad.select("id", F.col("g")[0].alias("g0"), F.col("g")[1].alias("g1")), "g0", "g1")


@query("tsne_q", f"WITH {DRAWING}, {_REP} SELECT id, {r('z', 'z')} FROM rep")
def tsne_q(spark, d):
    return rounded(E.kernel_sums(drawing(spark, d)).select("id", "z"), "z")


@query("tsne_attraction", f"WITH {_JE}, {_ATT} SELECT id, {r('a0', 'a0')}, {r('a1', 'a1')} FROM att")
def tsne_attraction(spark, d):
    return rounded(E.attraction(drawing(spark, d), _je(spark, d)).select("id", F.col("a")[0].alias("a0"), F.col("a")[1].alias("a1")), "a0", "a1")


@query("tsne_grad", f"WITH {_GRAD} SELECT id, {r('g0', 'g0')}, {r('g1', 'g1')} FROM grad")
def tsne_grad(spark, d):
    return _g(E.gradient(drawing(spark, d), _je(spark, d), 4.0))


@query("tsne_grad_piled", f"WITH {_GRAD} SELECT id, {r('g0', 'g0')}, {r('g1', 'g1')} FROM grad")
def tsne_grad_piled(spark, d):
    """The same forces by a tree over piles of points, here fine ones of which none stands for others, so that they are exact."""
    y = drawing(spark, d)
    return _g(E.gradient(y, _je(spark, d), 4.0, sums=E.piled_sums(y, theta=1e-9, least=1e-3)))


@query("wtsne_grad", f"""WITH {_JE}, {_ATT}, wd AS (SELECT *, (id % 3) + 1.0 AS m FROM drawing), rep AS (SELECT a.id, sum(q*a.m*b.m) AS z, sum(q*q*a.m*b.m*(a.y0-b.y0)) AS f0, sum(q*q*a.m*b.m*(a.y1-b.y1)) AS f1 FROM wd a JOIN wd b ON a.id <> b.id, LATERAL (SELECT 1 / (1 + (a.y0-b.y0)*(a.y0-b.y0) + (a.y1-b.y1)*(a.y1-b.y1)) AS q) GROUP BY a.id)
 SELECT id, {r('4 * (coalesce(a0, 0) - f0 / (SELECT sum(z) FROM rep))', 'g0')}, {r('4 * (coalesce(a1, 0) - f1 / (SELECT sum(z) FROM rep))', 'g1')} FROM rep LEFT JOIN att USING (id)""")
def wtsne_grad(spark, d):
    y = drawing(spark, d)
    return _g(E.gradient(y, _je(spark, d), 1.0, y.select("id", ((F.col("id") % 3) + 1.0).alias("weight"))))


def _upd(k: int) -> str:
    gain = f"greatest(0.1, CASE WHEN sign(g{k}) <> sign(v{k}) THEN 1.0 + 0.2 ELSE 0.8 END)"
    return f"{gain} AS n{k}, 0.2 * v{k} - 200 * {gain} * g{k} AS u{k}"


@query("tsne_step", f"WITH {_GRAD}, s AS (SELECT id, y0, y1, CASE WHEN id % 2 = 0 THEN 0.01 ELSE -0.01 END AS v0, 0.02 AS v1, g0, g1 FROM drawing JOIN grad USING (id)), u AS (SELECT *, {_upd(0)}, {_upd(1)} FROM s) SELECT id, {r('y0 + u0', 'y0')}, {r('y1 + u1', 'y1')}, {r('n0', 'gain0')} FROM u")
def tsne_step(spark, d):
    y = drawing(spark, d)
    state = y.select("id", "y", F.array(F.when(F.col("id") % 2 == 0, 0.01).otherwise(-0.01), F.lit(0.02)).alias("v"), F.array(F.lit(1.0), F.lit(1.0)).alias("gain"))
    out = E.updated(state, E.gradient(y, _je(spark, d), 4.0), E.Parameters(), 10)
    return rounded(out.select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"), F.col("gain")[0].alias("gain0")), "y0", "y1", "gain0")


@query("kl", f"WITH {_JE}, {_REP} SELECT {r('sum(w * ln(w / (q / (SELECT sum(z) FROM rep))))', 'kl')} FROM je JOIN drawing a ON a.id = i JOIN drawing b ON b.id = j, LATERAL (SELECT 1 / (1 + (a.y0-b.y0)*(a.y0-b.y0) + (a.y1-b.y1)*(a.y1-b.y1)) AS q)")
def kl(spark, d):
    return rounded(E.kullback_leibler(drawing(spark, d), _je(spark, d)), "kl")


@query("exaggeration_schedule", f"WITH t AS (SELECT unnest(range(0, 500, 10)) AS t) SELECT CAST(t AS INT) AS t, {r('CASE WHEN t <= 250 THEN 4.0 WHEN t > 400 THEN 1.0 ELSE 1 + 3 * (1 - (t - 250) / 150.0) END', 'linear')}, {r('CASE WHEN t <= 250 THEN 4.0 WHEN t > 400 THEN 1.0 ELSE 1 + 3 * exp(-(t - 250) / 30.0) END', 'exponential')}, CASE WHEN t < 250 THEN 4.0 ELSE 1.0 END AS hard FROM t")
def exaggeration_schedule(spark, d):
    rows = [(t, E.exaggeration(t, E.Parameters()), E.exaggeration(t, E.Parameters(decay="exponential")), E.exaggeration(t, E.EXACT)) for t in range(0, 500, 10)]
    return rounded(spark.createDataFrame(rows, "t int, linear double, exponential double, hard double"), "linear", "exponential")


@query("size_schedule", f"WITH n AS (SELECT unnest([500, 1000, 5000, 8000, 15000, 50000]) AS n), f AS (SELECT n, greatest(0, least(1, (n - 1000) / 14000.0)) AS f FROM n) SELECT CAST(n AS INT) AS n, {r('0.5 * f', 'theta')}, {r('1.5 + 8.5 * f', 'exaggeration')} FROM f")
def size_schedule(spark, d):
    return rounded(spark.createDataFrame([(n, *E.schedule(n)) for n in (500, 1000, 5000, 8000, 15000, 50000)], "n int, theta double, exaggeration double"), "theta", "exaggeration")


@query("initial_positions", f"WITH {PTS}, u AS (SELECT id, sqrt(-2 * ln(greatest({rng.uniform_sql(0, 'id', '1')}, 1e-12))) AS r, 2 * pi() * {rng.uniform_sql(0, 'id', '2')} AS a FROM pts) SELECT id, {r('r * cos(a) * 0.1', 'y0')}, {r('r * sin(a) * 0.1', 'y1')} FROM u")
def initial_positions(spark, d):
    return rounded(E.initial(panel(spark, d), E.Parameters()).select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1")


@query("row_sums", f"WITH {edges_sql()} SELECT i AS id, {r('sum(w)', 'weight')} FROM edges GROUP BY i")
def row_sums(spark, d):
    return rounded(E.row_sums(edges(spark, d)), "weight")


@query("repaired_rows", f"WITH {edges_sql()}, keep AS (SELECT * FROM edges WHERE w > 0.55), n AS (SELECT id AS i, 7 - count(j) AS missing FROM pts LEFT JOIN keep ON keep.i = pts.id GROUP BY id), k AS (SELECT i, missing, unnest(range(missing)) AS k FROM n WHERE missing > 0), p AS (SELECT id AS j, row_number() OVER (ORDER BY id) - 1 AS number FROM pts) SELECT i, j, {r('w', 'w')} FROM keep UNION ALL SELECT i, j, {r('1.0 / missing', 'w')} FROM k JOIN p ON p.number = ({rng.number_sql(0, '(i * 7 + k)')} % (SELECT count(*) FROM pts))")
def repaired_rows(spark, d):
    return rounded(E.repaired_rows(edges(spark, d).filter("w > 0.55"), panel(spark, d).select("id")), "w")


_GRIDS = """b AS (SELECT min(y0) - (max(y0)-min(y0))*0.05 AS a0, (max(y0)-min(y0))*1.1 AS e0, min(y1) - (max(y1)-min(y1))*0.05 AS a1, (max(y1)-min(y1))*1.1 AS e1 FROM drawing),
 g AS (SELECT *, CAST(greatest(floor(2*e0), 5) AS INT) AS n0, CAST(greatest(floor(2*e1), 5) AS INT) AS n1 FROM b),
 px AS (SELECT r, c, (c + 0.5) / n0 * e0 + a0 AS x, (r + 0.5) / n1 * e1 + a1 AS y FROM g, (SELECT unnest(range(100)) AS r), (SELECT unnest(range(100)) AS c) WHERE r < n1 AND c < n0)"""


@query("field_at_grid", f"WITH {DRAWING}, {_GRIDS} SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, {r('sum(t)', 's')}, {r('sum(t*t*(x-y0))', 'vx')}, {r('sum(t*t*(y-y1))', 'vy')} FROM px, drawing, LATERAL (SELECT 1 / (1 + (x-y0)*(x-y0) + (y-y1)*(y-y1)) AS t) GROUP BY r, c")
def field_at_grid(spark, d):
    """The field as a plan: pixels are few (a grid over the box), points are scanned once and summed by pixel."""
    y = drawing(spark, d).select(F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"))
    box = y.agg(F.min("y0").alias("l0"), F.max("y0").alias("h0"), F.min("y1").alias("l1"), F.max("y1").alias("h1"))
    e0, e1 = (F.col("h0") - F.col("l0")) * 1.1, (F.col("h1") - F.col("l1")) * 1.1
    grid = box.select((F.col("l0") - (F.col("h0") - F.col("l0")) * 0.05).alias("a0"), e0.alias("e0"), (F.col("l1") - (F.col("h1") - F.col("l1")) * 0.05).alias("a1"), e1.alias("e1"), F.greatest(F.floor(2 * e0), F.lit(5)).cast("int").alias("n0"), F.greatest(F.floor(2 * e1), F.lit(5)).cast("int").alias("n1"))
    px = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("n0") - 1)).alias("col"))
    px = px.select("row", "col", ((F.col("col") + 0.5) / F.col("n0") * F.col("e0") + F.col("a0")).alias("x"), ((F.col("row") + 0.5) / F.col("n1") * F.col("e1") + F.col("a1")).alias("y"))
    dx, dy = F.col("x") - F.col("y0"), F.col("y") - F.col("y1")
    t = 1 / (1 + dx * dx + dy * dy)
    rows = y.crossJoin(F.broadcast(px)).select("row", "col", t.alias("t"), (t * t * dx).alias("vx"), (t * t * dy).alias("vy"))
    return rounded(rows.groupBy("row", "col").agg(F.sum("t").alias("s"), F.sum("vx").alias("vx"), F.sum("vy").alias("vy")), "s", "vx", "vy")


def _run(name, build):
    @query(name)
    def run(spark, d):
        return rounded(build(spark, d).select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1", digits=4)


_SMALLP = M.Parameters(perplexity=10)
_run("tsne_full", lambda s, d: E.tsne(panel(s, d), _SMALLP, iterations=60))
_run("bh_tsne_full", lambda s, d: E.tsne(panel(s, d), _SMALLP, E.Parameters(theta=0.5), iterations=60))
_run("field_tsne_full", lambda s, d: E.tsne(panel(s, d), _SMALLP, E.Parameters(repulsion="field"), iterations=60))
_run("raster_tsne_full", lambda s, d: E.tsne(panel(s, d), _SMALLP, E.Parameters(repulsion="raster"), iterations=60))
_run("wtsne_full", lambda s, d: E.weighted_tsne(panel(s, d), _SMALLP, iterations=60))
_run("exact_tsne_full", lambda s, d: E.exact_tsne(panel(s, d), 10, iterations=60))
_run("rw_tsne_full", lambda s, d: E.random_walk_tsne(panel(s, d), neighbours=10, iterations=60))

# --- hierarchy ----------------------------------------------------------------

_AREA = f"{PTS}, a0 AS (SELECT id AS prev, (id // 5) * 5 AS lm, CAST(0.6 AS DOUBLE) AS p FROM pts UNION ALL SELECT id, (((id + 40) % 500) // 5) * 5, CAST(0.4 AS DOUBLE) FROM pts), a1 AS (SELECT prev, lm, sum(p) AS p FROM a0 GROUP BY 1, 2), b0 AS (SELECT DISTINCT lm AS prev, (lm // 25) * 25 AS lm, CAST(0.7 AS DOUBLE) AS p FROM a1 UNION ALL SELECT DISTINCT lm, (((lm + 100) % 500) // 25) * 25, CAST(0.3 AS DOUBLE) FROM a1), b1 AS (SELECT prev, lm, sum(p) AS p FROM b0 GROUP BY 1, 2)"


def hierarchy(spark, d):
    """A fixed hierarchy of three scales: every fifth, and every twenty-fifth point, each point belonging to two."""
    ids = panel(spark, d).select("id")
    five = lambda c, n: F.call_function("div", c, F.lit(n)) * n
    a = ids.select(F.col("id").alias("prev"), five(F.col("id"), 5).alias("lm"), F.lit(0.6).alias("p")).unionByName(ids.select(F.col("id").alias("prev"), five((F.col("id") + 40) % 500, 5).alias("lm"), F.lit(0.4).alias("p"))).groupBy("prev", "lm").agg(F.sum("p").alias("p"))
    l1 = a.select("lm").distinct()
    b = l1.select(F.col("lm").alias("prev"), five(F.col("lm"), 25).alias("lm"), F.lit(0.7).alias("p")).unionByName(l1.select(F.col("lm").alias("prev"), five((F.col("lm") + 100) % 500, 25).alias("lm"), F.lit(0.3).alias("p"))).groupBy("prev", "lm").agg(F.sum("p").alias("p"))
    table = lambda df: df.select("lm", F.col("lm").alias("orig_id"), F.col("lm").alias("prev_id"), F.lit(1.0).alias("weight"))
    scales = [H.Scale(table(ids.select(F.col("id").alias("lm"))), transition(spark, d)), H.Scale(table(l1), transition(spark, d), a), H.Scale(table(b.select("lm").distinct()), transition(spark, d), b)]
    return H.Hierarchy(scales)


_CHAIN = f"{_AREA}, c2 AS (SELECT a1.prev AS id, b1.lm, sum(a1.p * b1.p) AS p FROM a1 JOIN b1 ON b1.prev = a1.lm GROUP BY 1, 2)"


@query("interpolation_weights", f"WITH {_CHAIN} SELECT id, lm, {r('p', 'p')} FROM c2")
def interpolation_weights(spark, d):
    return rounded(H.interpolation_weights(hierarchy(spark, d)), "p")


@query("influence_on_point", f"WITH {_CHAIN}, x AS (SELECT 0 AS scale, CAST(77 AS BIGINT) AS lm, 1.0 AS p UNION ALL SELECT 1, lm, p FROM a1 WHERE prev = 77 UNION ALL SELECT 2, lm, p FROM c2 WHERE id = 77) SELECT scale, lm, {r('p / sum(p) OVER (PARTITION BY scale)', 'p')} FROM x")
def influence_on_point(spark, d):
    return rounded(H.influence_on(hierarchy(spark, d), 77), "p")


@query("area_of_influence", f"WITH {_CHAIN} SELECT id, {r('sum(p)', 'p')} FROM c2 WHERE lm IN (0, 100, 225) GROUP BY id")
def area_of_influence(spark, d):
    h = hierarchy(spark, d)
    return rounded(H.area_of_influence(h, 2, h.scales[2].landmarks.filter("lm IN (0, 100, 225)").select(F.col("lm").alias("id"))), "p")


@query("aoi_topdown", f"WITH {_AREA}, s1 AS (SELECT prev AS lm FROM b1 WHERE lm IN (0, 100, 225) GROUP BY prev HAVING sum(p) > 0.3) SELECT prev AS id FROM a1 WHERE lm IN (SELECT lm FROM s1) GROUP BY prev HAVING sum(p) > 0.3")
def aoi_topdown(spark, d):
    h = hierarchy(spark, d)
    return H.area_top_down(h, 2, h.scales[2].landmarks.filter("lm IN (0, 100, 225)").select(F.col("lm").alias("id")))


@query("influenced_prev", f"WITH {_AREA} SELECT prev AS id, {r('sum(p)', 'influence')} FROM a1 WHERE lm % 20 = 0 GROUP BY prev HAVING sum(p) > 0")
def influenced_prev(spark, d):
    return rounded(H.influenced_below(hierarchy(spark, d).scales[1].aoi, panel(spark, d).filter("id % 20 = 0").select("id")), "influence")


@query("influencing_next", f"WITH {_AREA}, x AS (SELECT lm AS id, sum(CASE WHEN prev % 3 = 0 THEN p ELSE 0 END) / sum(p) AS v FROM a1 GROUP BY lm) SELECT id, {r('v', 'influence')} FROM x WHERE v > 0")
def influencing_next(spark, d):
    return rounded(H.influencing_above(hierarchy(spark, d).scales[1].aoi, panel(spark, d).filter("id % 3 = 0").select("id")), "influence")


@query("dominant_landmark", f"WITH {_CHAIN} SELECT id, lm, {r('p', 'p')} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, lm) AS rk FROM c2) WHERE rk = 1")
def dominant_landmark(spark, d):
    return rounded(H.dominant(H.interpolation_weights(hierarchy(spark, d))), "p")


@query("aoi_functor", f"WITH {_CHAIN}, a AS (SELECT id, sum(p) AS p FROM c2 WHERE lm IN (0, 100) GROUP BY id) SELECT {r('sum(a.p * pts.label) / sum(a.p)', 'mean')} FROM a JOIN pts USING (id)")
def aoi_functor(spark, d):
    h = hierarchy(spark, d)
    chosen = h.scales[2].landmarks.filter("lm IN (0, 100)").select(F.col("lm").alias("id"))
    return rounded(H.over_area(h, 2, chosen, lambda a: a.join(panel(spark, d).select("id", "label"), "id").agg((F.sum(F.col("p") * F.col("label")) / F.sum("p")).alias("mean"))), "mean")


_UPPER = "up AS (SELECT DISTINCT lm, CAST(lm // 100 AS INT) AS c FROM b1 WHERE lm // 100 % 5 < 4), lo AS (SELECT DISTINCT lm, CAST(lm // 50 AS INT) AS c FROM a1 WHERE lm // 50 % 10 < 6)"


def _clusters(spark, d):
    """Clusters of both scales; a fifth of the upper and four tenths of the lower landmarks are left unclustered."""
    h = hierarchy(spark, d)
    group = lambda s, n: F.call_function("div", F.col("lm"), F.lit(n)).cast("int").alias("cluster_id")
    return h, h.scales[2].landmarks.filter("lm div 100 % 5 < 4").select(group(2, 100), "lm"), h.scales[1].landmarks.filter("lm div 50 % 10 < 6").select(group(1, 50), "lm")


@query("cluster_flow", f"WITH {_AREA}, {_UPPER} SELECT coalesce(lo.c + 1, 0) AS source, coalesce(up.c + 1, 0) AS target, {r('sum(p)', 'value')} FROM b1 LEFT JOIN up ON up.lm = b1.lm LEFT JOIN lo ON lo.lm = b1.prev GROUP BY 1, 2")
def cluster_flow(spark, d):
    h, up, lo = _clusters(spark, d)
    return rounded(H.flow_between(h.scales[2].aoi, h.scales[1].landmarks.select(F.col("lm").alias("prev"), "weight"), up, lo), "value")


_BEST = f"{_AREA}, {_UPPER}, m AS (SELECT lo.c AS k, coalesce(up.c, -1) AS best, sum(p) AS m FROM b1 JOIN lo ON lo.lm = b1.prev LEFT JOIN up ON up.lm = b1.lm GROUP BY 1, 2), f AS (SELECT k, best FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m DESC, best) AS rk FROM m) WHERE rk = 1)"


@query("cluster_consistency", f"WITH {_BEST} SELECT k AS cluster_id, best = k // 2 AS ok FROM f")
def cluster_consistency(spark, d):
    h, up, lo = _clusters(spark, d)
    tree = lo.select("cluster_id", F.call_function("div", F.col("cluster_id"), F.lit(2)).cast("int").alias("parent_id")).distinct()
    return H.consistent(h.scales[2].aoi, tree, lo, up)


@query("point_to_cluster", f"""WITH {_CHAIN}, {_UPPER}, m2 AS (SELECT id, c, sum(p) AS m FROM c2 LEFT JOIN up ON up.lm = c2.lm GROUP BY 1, 2),
 t AS (SELECT id, c, m FROM (SELECT id, c, m, sum(CASE WHEN c IS NULL THEN m ELSE 0 END) OVER (PARTITION BY id) AS free, row_number() OVER (PARTITION BY id ORDER BY c IS NULL, m DESC, c) AS rk FROM m2) WHERE rk = 1 AND c IS NOT NULL AND m > free),
 m1 AS (SELECT t.id, CASE WHEN lo.c // 2 = t.c THEN lo.c END AS c, sum(p) AS m FROM t JOIN a1 ON a1.prev = t.id LEFT JOIN lo ON lo.lm = a1.lm GROUP BY 1, 2),
 s AS (SELECT id, c, m FROM (SELECT id, c, m, sum(CASE WHEN c IS NULL THEN m ELSE 0 END) OVER (PARTITION BY id) AS free, row_number() OVER (PARTITION BY id ORDER BY c IS NULL, m DESC, c) AS rk FROM m1) WHERE rk = 1 AND c IS NOT NULL AND m > free)
 SELECT id, CASE WHEN s.id IS NOT NULL THEN 1 ELSE 2 END AS scale, coalesce(s.c, t.c, -1) AS cluster_id, {r('coalesce(s.m, t.m, 1.0)', 'influence')} FROM pts LEFT JOIN t USING (id) LEFT JOIN s USING (id)""")
def point_to_cluster(spark, d):
    h, up, lo = _clusters(spark, d)
    members = up.select(F.lit(2).alias("scale"), "cluster_id", "lm").unionByName(lo.select(F.lit(1).alias("scale"), "cluster_id", "lm"))
    tree = up.select(F.lit(2).alias("scale"), "cluster_id", F.lit(None).cast("int").alias("parent_id")).distinct().unionByName(lo.select(F.lit(1).alias("scale"), "cluster_id", F.call_function("div", F.col("cluster_id"), F.lit(2)).cast("int").alias("parent_id")).distinct())
    return rounded(H.point_clusters(h, tree, members), "influence")


@query("hsne_full")
def hsne_full(spark, d):
    h = H.from_points(panel(spark, d), H.Parameters(neighbours=12, walks=6, walk_length=5, walks_per_landmark=20, max_jumps=20, prune=1.5))
    return rounded(H.add_scale(h).scales[1].landmarks, "weight")


# --- sessions and views -------------------------------------------------------

_DRILL = f"{transition_sql(5)}, {_AREA.removeprefix(PTS + ', ')}, s AS (SELECT prev AS id, row_number() OVER (ORDER BY prev) - 1 AS number FROM a1 WHERE lm % 20 = 0 GROUP BY prev HAVING sum(p) > 0.5), e AS (SELECT x.number AS i, y.number AS j, w FROM t JOIN s x ON x.id = t.i JOIN s y ON y.id = t.j)"


@query("drill_in", f"WITH {_DRILL} SELECT i, j, {r('w * (SELECT count(*) FROM s) / (SELECT sum(w) FROM e)', 'w')} FROM e")
def drill_in(spark, d):
    h = hierarchy(spark, d)
    return rounded(S.drill_in(h.scales[1].aoi, transition(spark, d), panel(spark, d).filter("id % 20 = 0").select("id"))[1], "w")


@query("surviving_landmarks", f"WITH {_AREA} SELECT id AS lm, CASE WHEN id IN (SELECT lm FROM a1) THEN 0 ELSE 4 END AS flags FROM pts")
def surviving_landmarks(spark, d):
    h = hierarchy(spark, d)
    return S.surviving(h.scales[0].landmarks, h.scales[1].landmarks)


_BIP = f"{_MEMBER}, da AS (SELECT a AS id, a % 5 AS lm FROM (SELECT DISTINCT a FROM m)), db AS (SELECT b AS id, b % 7 AS lm FROM (SELECT DISTINCT b FROM m)), con AS (SELECT da.lm AS a, db.lm AS b, count(*) AS n FROM m JOIN da ON da.id = m.a JOIN db ON db.id = m.b GROUP BY 1, 2)"


def _bipartite(spark, d):
    m = membership(spark, d)
    side = lambda c, n: m.select(F.col(c).alias("id")).distinct().select("id", (F.col("id") % n).alias("lm"))
    return m, side("a", 5), side("b", 7)


@query("bipartite_connections", f"WITH {_BIP} SELECT * FROM con")
def bipartite_connections(spark, d):
    m, a, b = _bipartite(spark, d)
    return S.connections(a, m, b)


@query("bipartite_greedy", f"WITH {_BIP} SELECT m.a, db.lm AS b, count(*) AS n FROM m JOIN db ON db.id = m.b GROUP BY 1, 2")
def bipartite_greedy(spark, d):
    m, a, b = _bipartite(spark, d)
    return S.greedy_connections(a.select("id"), m, b)


@query("bipartite_incoming", f"WITH {_BIP} SELECT b, CAST(sum(n) AS BIGINT) AS total FROM con GROUP BY b")
def bipartite_incoming(spark, d):
    m, a, b = _bipartite(spark, d)
    return S.incoming(S.connections(a, m, b))


@query("linked_selection", f"WITH {_BIP} SELECT b, {r('sum(CASE WHEN a IN (1, 3) THEN n ELSE 0 END) / sum(n) * 2', 'v')} FROM con GROUP BY b")
def linked_selection(spark, d):
    m, a, b = _bipartite(spark, d)
    chosen = a.select(F.col("lm").alias("id")).distinct().filter("id IN (1, 3)")
    return rounded(S.linked_selection(S.connections(a, m, b), chosen, 2.0), "v")


@query("visible_lines", f"WITH {_BIP} SELECT a, b, {r('0.5 * n / (SELECT max(n) FROM con)', 'alpha')} FROM con WHERE 0.5 * n / (SELECT max(n) FROM con) > 0.45")
def visible_lines(spark, d):
    m, a, b = _bipartite(spark, d)
    return rounded(S.visible_lines(S.connections(a, m, b), 0.5, 0.45), "alpha")


@query("bipartite_session")
def bipartite_session(spark, d):
    """Overview of suppliers and parts as sets of each other: both top scales' similarities, weights and links."""
    from ..operators import bipartite as B

    p = H.Parameters(neighbours=12, walks=6, walk_length=5, walks_per_landmark=20, max_jumps=20)
    return rounded(B.tables(B.overview(B.session(membership(spark, d), p, most_top=500))), "w")


@query("cluster_move", f"WITH {PTS}, c AS (SELECT label AS cluster_id, id FROM pts) SELECT cluster_id, id FROM c WHERE id % 9 <> 0 UNION ALL SELECT 50, id FROM c WHERE id % 9 = 0")
def cluster_move(spark, d):
    p = panel(spark, d)
    return S.move_cluster(p.select(F.col("label").alias("cluster_id"), "id"), p.filter("id % 9 = 0").select("id"), 50)


@query("selection_in_data", f"WITH {PTS} SELECT id AS view_id, id * 2 AS lm, id * 2 AS orig_id FROM pts WHERE label = 3 AND id < 250")
def selection_in_data(spark, d):
    p = panel(spark, d)
    return S.original_ids(p.filter("label = 3"), p.select(F.col("id").alias("lm"), F.col("id").alias("orig_id")), p.filter("id < 250").select(F.col("id").alias("view_id"), (F.col("id") * 2).alias("lm")))


_LAY = "lay AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"


@query("scatter_layer", f"WITH {_LAY} SELECT id, x, y, {r('(x - (SELECT min(x) FROM lay)) / (SELECT max(x) - min(x) FROM lay)', 'attribute')}, label, CASE WHEN label = 3 THEN 1 ELSE 0 END AS selected FROM lay")
def scatter_layer(spark, d):
    return rounded(S.scatter_layer(layout(spark, d), "x", "label"), "attribute")


_SEG = f"{edges_sql(2)}, {_LAY}, seg AS (SELECT i AS a, j AS b, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, w AS alpha FROM edges JOIN lay p ON p.id = i JOIN lay q ON q.id = j)"


def _segments(spark, d):
    l = layout(spark, d)
    return S.lines(l, l, edges(spark, d, 2).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("w").alias("alpha")))


@query("embedding_lines", f"WITH {_SEG} SELECT a, b, x0, y0, x1, y1, {r('alpha', 'alpha')} FROM seg")
def embedding_lines(spark, d):
    return rounded(_segments(spark, d), "alpha")


@query("control_points", f"WITH {_SEG} SELECT a, b, CAST(k AS INT) AS k, {r('x0 + (x1 - x0) * k / 5', 'x')}, {r('y0 + (y1 - y0) * k / 5', 'y')} FROM seg, (SELECT unnest(range(6)) AS k)")
def control_points(spark, d):
    return rounded(S.control_points(_segments(spark, d), 6), "x", "y")


@query("bundle_step", f"""WITH {_SEG}, cp AS (SELECT a, b, CAST(k AS INT) AS k, x0 + (x1 - x0) * k / 5 AS x, y0 + (y1 - y0) * k / 5 AS y FROM seg, (SELECT unnest(range(6)) AS k)), n AS (SELECT count(DISTINCT (a, b)) AS n FROM cp),
 pull AS (SELECT p.a, p.b, p.k, sum(CASE WHEN abs(q.x - p.x) < 0.1 THEN q.x - p.x ELSE 0 END) * 0.1 / max(n) AS px, sum(CASE WHEN abs(q.y - p.y) < 0.1 THEN q.y - p.y ELSE 0 END) * 0.1 / max(n) AS py FROM cp p JOIN cp q ON p.k = q.k AND NOT (p.a = q.a AND p.b = q.b), n GROUP BY 1, 2, 3),
 f AS (SELECT a, b, k, x, y, lag(x) OVER o + lead(x) OVER o - 2 * x + px AS fx, lag(y) OVER o + lead(y) OVER o - 2 * y + py AS fy FROM cp JOIN pull USING (a, b, k) WINDOW o AS (PARTITION BY a, b ORDER BY k))
 SELECT a, b, k, {r('x + CASE WHEN k BETWEEN 1 AND 4 THEN fx * 0.15 * 0.98 ELSE 0 END * 0.15', 'x')}, {r('y + CASE WHEN k BETWEEN 1 AND 4 THEN fy * 0.15 * 0.98 ELSE 0 END * 0.15', 'y')} FROM f""")
def bundle_step(spark, d):
    points = S.control_points(_segments(spark, d), 6).withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0))
    return rounded(S.bundle_step(points, 6).select("a", "b", "k", "x", "y"), "x", "y")


@query("heatmap_table", f"WITH {CELLS} SELECT 'selection' AS x_label, dim AS y_label, {r('avg(x)', 'value')}, 1.0 AS confidence FROM cells WHERE label = 3 GROUP BY dim")
def heatmap_table(spark, d):
    return rounded(S.heatmap_table(panel(spark, d), "selection"), "value")


@query("parallel_coordinates", f"WITH {CELLS} SELECT id, dim, x FROM cells WHERE label = 3 AND dim < 20")
def parallel_coordinates(spark, d):
    return S.parallel_coordinates(panel(spark, d).withColumn("features", F.slice("features", 1, 20)))


@query("line_series", f"WITH {PTS} SELECT id, f[3] AS x, f[5] AS y FROM pts")
def line_series(spark, d):
    return S.line_series(panel(spark, d), 2, 4)


@query("sankey_csv", "SELECT 'node' AS kind, n_nationkey AS id, n_nationkey || ',' || n_name || ',#' || lpad(lower(printf('%x', CAST(n_nationkey * 9 AS INT))), 2, '0') || '10ff' AS csv FROM nation UNION ALL SELECT 'link', s_suppkey, s_suppkey || ',' || s_nationkey || ',' || (s_suppkey % 25) || ',' || (s_suppkey % 4) FROM supplier")
def sankey_csv(spark, d):
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"), (F.col("n_nationkey") * 9).cast("int").alias("r"), F.lit(16).alias("g"), F.lit(255).alias("b"))
    links = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("source"), (F.col("s_suppkey") % 25).alias("target"), (F.col("s_suppkey") % 4).alias("value"))
    return S.sankey_csv(nodes, links)


@query("wordcloud_topk", f"WITH {_BIP}, l AS (SELECT b, sum(CASE WHEN a IN (1, 3) THEN n ELSE 0 END) / sum(n) AS v FROM con GROUP BY b) SELECT CAST(b AS VARCHAR) AS text, {r('10 * v', 'size')} FROM l WHERE v > 0.3 * (SELECT max(v) FROM l) ORDER BY v DESC, text LIMIT 5")
def wordcloud_topk(spark, d):
    m, a, b = _bipartite(spark, d)
    linked = S.linked_selection(S.connections(a, m, b), a.select(F.col("lm").alias("id")).distinct().filter("id IN (1, 3)"))
    return rounded(S.word_cloud(linked.select(F.col("b").cast("string").alias("text"), "v"), 5), "size")


@query("wordcloud_by_weight", f"SELECT n_name AS text, {r('sqrt(n) / sqrt(max(n) OVER ()) * 10 + 1', 'size')} FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) ORDER BY n DESC, text LIMIT 12")
def wordcloud_by_weight(spark, d):
    n = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("text")).agg(F.count(F.lit(1)).alias("weight"))
    return rounded(S.word_cloud_by_weight(n, 12), "size")


@query("filter_activity", f"SELECT CAST(event_id AS VARCHAR) AS name, CAST(event_id % 10 AS INT) AS \"order\", value, {r('greatest(0.0, least(1.0, 1.0 - (10000.0 - event_id) / 500.0))', 'confidence')}, 0 AS flags, 1 AS frequency FROM events")
def filter_activity(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("name"), (F.col("event_id") % 10).cast("int").alias("order"), "value", F.col("event_id").cast("double").alias("seen"), F.lit(0).alias("flags"), F.lit(1).alias("frequency"))
    return rounded(S.filter_activity(e, 10000), "confidence")


@query("heatmap_tiles", f"WITH {CELLS}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM cells) SELECT id, CAST(dim // 9 AS INT) AS row, CAST(dim % 9 AS INT) AS \"column\", {r('(x - lo) / (hi - lo)', 'v')} FROM cells, b")
def heatmap_tiles(spark, d):
    return rounded(S.tiles(panel(spark, d)), "v")


@query("voxel_planes", """WITH v AS (SELECT l_partkey % 8 AS x, l_suppkey % 8 AS y, l_orderkey % 8 AS z FROM lineitem WHERE l_returnflag = 'R')
 SELECT 'x' AS plane, y AS u, z AS v, count(*) AS n FROM v WHERE x = 3 GROUP BY 1, 2, 3 UNION ALL SELECT 'y', x, z, count(*) FROM v WHERE y = 4 GROUP BY 1, 2, 3 UNION ALL SELECT 'z', x, y, count(*) FROM v WHERE z = 5 GROUP BY 1, 2, 3""")
def voxel_planes(spark, d):
    v = read(spark, d, "lineitem").select((F.col("l_partkey") % 8).alias("x"), (F.col("l_suppkey") % 8).alias("y"), (F.col("l_orderkey") % 8).alias("z"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("flags"))
    return S.voxel_planes(v, 3, 4, 5)


@query("matrix_image", f"WITH {edges_sql()} SELECT i AS row, j AS col, CAST(floor(least(w / (SELECT max(w) FROM edges), 1.0) * 255) AS INT) AS grey FROM edges")
def matrix_image(spark, d):
    return S.matrix_image(edges(spark, d))


@query("signed_image", f"WITH {CELLS}, m AS (SELECT max(abs(x)) AS m FROM cells) SELECT id AS row, dim AS col, CASE WHEN x < 0 THEN CAST(floor(abs(x) / m * 255) AS INT) ELSE 0 END AS r, CASE WHEN x > 0 THEN CAST(floor(abs(x) / m * 255) AS INT) ELSE 0 END AS g, 0 AS b FROM cells, m")
def signed_image(spark, d):
    return S.signed_image(to_cells(panel(spark, d)).select(F.col("id").alias("i"), F.col("dim").alias("j"), F.col("x").alias("w")))


@query("dy_text", f"WITH {PTS} SELECT id, 'P' || id || ';' || array_to_string(list_transform(f, lambda v: CAST(CAST(floor(v * 1000) AS BIGINT) AS VARCHAR)), ';') || ';' || label || '.0' AS line FROM pts")
def dy_text(spark, d):
    from ..sources.text_formats import dy_rows

    points = panel(spark, d).withColumn("features", F.transform("features", lambda v: F.floor(v * 1000)))
    return dy_rows(points, "label")


@query("ragged_stats", "SELECT CAST(len(string_split(text, ' ')) AS INT) AS columns, count(*) AS n FROM documents GROUP BY 1")
def ragged_stats(spark, d):
    from ..sources.text_formats import ragged

    return ragged(read(spark, d, "documents").select(F.col("text").alias("value")), " ")
