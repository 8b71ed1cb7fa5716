"""Queries over panel data: scans, profiles, normalisation, selections, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import panel as P
from ..operators import session as S
from ..schema import is_set, to_cells
from .registry import CELLS, DRAWING, PTS, drawing, layout, panel, query, read, rounded


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


@query("dim_mean", f"WITH {CELLS} SELECT dim, {r('avg(x)', 'mean')} FROM cells GROUP BY dim")
def dim_mean(spark, d):
    return rounded(P.mean(panel(spark, d)), "mean")


@query("selection_mean", f"WITH {CELLS} SELECT dim, {r('avg(x)', 'mean')} FROM cells WHERE label = 3 GROUP BY dim")
def selection_mean(spark, d):
    return rounded(P.selection_mean(panel(spark, d)), "mean")


def _weighted(spark, d):
    return panel(spark, d).withColumn("weight", (F.col("label") + 1).cast("double"))


@query("weighted_mean", f"WITH {CELLS} SELECT dim, {r('sum((label + 1) * x) / sum(label + 1)', 'mean')} FROM cells GROUP BY dim")
def weighted_mean(spark, d):
    return rounded(P.mean(_weighted(spark, d), "weight"), "mean")


@query("weighted_std", f"WITH {CELLS}, m AS (SELECT dim, sum((label + 1) * x) / sum(label + 1) AS m FROM cells GROUP BY dim) SELECT dim, {r('sqrt(sum((label + 1) * (x - m) * (x - m)) / sum(label + 1))', 'stddev')} FROM cells JOIN m USING (dim) GROUP BY dim")
def weighted_std(spark, d):
    points = _weighted(spark, d)
    return rounded(P.weighted_stddev(points, "weight", P.mean(points, "weight")), "stddev")


@query("dim_minmax", f"WITH {CELLS} SELECT dim, min(x) AS lo, max(x) AS hi FROM cells GROUP BY dim")
def dim_minmax(spark, d):
    return P.extent(panel(spark, d))


@query("sparsity", f"SELECT {r('avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN l_tax = 0 THEN 1.0 ELSE 0.0 END) / 2', 'sparsity')} FROM lineitem")
def sparsity(spark, d):
    points = read(spark, d, "lineitem").select(F.array("l_discount", "l_tax").alias("features"))
    return rounded(P.sparsity(points), "sparsity")


@query("selection_profile", f"WITH {CELLS} SELECT dim, min(x) AS lo, max(x) AS hi, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'stddev')} FROM cells WHERE label = 3 GROUP BY dim")
def selection_profile(spark, d):
    return rounded(P.selection_profile(panel(spark, d)), "mean", "stddev")


@query("heatmap_profile", f"WITH {CELLS} SELECT dim, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'stddev')}, greatest(0.0, max(x)) AS hi FROM cells WHERE label = 3 GROUP BY dim")
def heatmap_profile(spark, d):
    return rounded(P.heatmap_profile(panel(spark, d)), "mean", "stddev")


HISTOGRAM = """WITH b AS (SELECT CAST(unnest(range(20)) AS INT) AS bucket), c AS (
  SELECT CAST(least(floor((l_extendedprice - 1000) / 80000.0 * 20), 19) AS INT) AS bucket, count(*) AS cnt FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 81000 GROUP BY 1)
SELECT bucket, 1000 + bucket * 4000.0 AS lo, 1000 + (bucket + 1) * 4000.0 AS hi, coalesce(cnt, 0) AS cnt FROM b LEFT JOIN c USING (bucket)"""


@query("histogram", HISTOGRAM)
def histogram(spark, d):
    return P.histogram(read(spark, d, "lineitem"), "l_extendedprice", 1000.0, 81000.0, 20)


@query("histogram_view", f"SELECT bucket * 4000.0 AS x0, (bucket + 1) * 4000.0 AS x1, CAST(cnt AS DOUBLE) AS v FROM ({HISTOGRAM})")
def histogram_view(spark, d):
    return S.histogram_view(read(spark, d, "lineitem"), "l_extendedprice", 1000.0, 81000.0, 20)


@query("vector_stats", f"SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, {r('sum(l_quantity)', 'total', 2)}, {r('avg(l_quantity)', 'mean')}, {r('stddev_pop(l_quantity)', 'stddev')}, count(l_quantity) AS n FROM lineitem")
def vector_stats(spark, d):
    return rounded(rounded(P.vector_stats(read(spark, d, "lineitem"), "l_quantity"), "mean", "stddev"), "total", digits=2)


@query("count_of", "SELECT count(*) AS n FROM lineitem WHERE l_quantity = 7")
def count_of(spark, d):
    return P.count_of(read(spark, d, "lineitem"), "l_quantity", 7.0)


@query("zscore", f"WITH {CELLS} SELECT id, dim, {r('(x - avg(x) OVER (PARTITION BY dim)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY dim) = 0 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY dim) END', 'x')} FROM cells")
def zscore(spark, d):
    return rounded(to_cells(P.zscore(panel(spark, d))), "x")


_BOX = "min(x) OVER (PARTITION BY dim) AS lo, max(x) OVER (PARTITION BY dim) AS hi"


def _with_constant(spark, d):
    return panel(spark, d).withColumn("features", F.transform("features", lambda v, i: F.when(i == 1, 4.0).otherwise(v)))


@query("minmax", f"WITH {CELLS}, c AS (SELECT id, dim, CASE WHEN dim = 1 THEN 4.0 ELSE x END AS x FROM cells), b AS (SELECT *, {_BOX} FROM c) SELECT id, dim, {r('CASE WHEN lo = hi THEN 0.5 ELSE (x - lo) / (hi - lo) END', 'x')} FROM b")
def minmax(spark, d):
    return rounded(to_cells(P.minmax(_with_constant(spark, d))), "x")


@query("minmax_keep_const", f"WITH {CELLS}, c AS (SELECT id, dim, CASE WHEN dim = 1 THEN 4.0 ELSE x END AS x FROM cells), b AS (SELECT *, {_BOX} FROM c) SELECT id, dim, {r('CASE WHEN lo = hi THEN x ELSE (x - lo) / (hi - lo) END', 'x')} FROM b")
def minmax_keep_const(spark, d):
    return rounded(to_cells(P.minmax(_with_constant(spark, d), keep_constant=True)), "x")


@query("transpose", f"WITH {CELLS}, n AS (SELECT CAST(dim AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY dim ORDER BY id) - 1 AS INT) AS dim, x FROM cells) SELECT * FROM n")
def transpose(spark, d):
    return to_cells(P.transpose(panel(spark, d)))


@query("gather", f"WITH {PTS}, w AS (SELECT unnest([7, 3, 3, 40, 0]) AS id, CAST(generate_subscripts([7, 3, 3, 40, 0], 1) - 1 AS INT) AS pos) SELECT pos, id, label, f[1] AS x FROM w JOIN pts USING (id)")
def gather(spark, d):
    return P.gather(panel(spark, d), [7, 3, 3, 40, 0]).select("pos", "id", "label", F.col("features")[0].alias("x"))


@query("dim_subset", f"WITH {PTS} SELECT id, f[6] AS a, f[1] AS b, f[64] AS c FROM pts")
def dim_subset(spark, d):
    f = F.col("features")
    return P.subset_dimensions(panel(spark, d), [5, 0, 63]).select("id", f[0].alias("a"), f[1].alias("b"), f[2].alias("c"))


@query("point_cell", f"WITH {PTS} SELECT id, f[10] AS x FROM pts WHERE id = 17")
def point_cell(spark, d):
    return P.cell(panel(spark, d), 17, 9)


@query("flag_test", f"WITH {PTS} SELECT id FROM pts WHERE label = 3")
def flag_test(spark, d):
    return panel(spark, d).filter(is_set(F.col("flags"))).select("id")


@query("append_points", f"WITH {PTS} SELECT id, label, CAST(NULL AS DOUBLE) AS mark FROM pts UNION ALL SELECT id + 100000, label, 1.0 FROM pts WHERE label = 3")
def append_points(spark, d):
    points = panel(spark, d).select("id", "label", "flags")
    more = P.with_property(points.filter("label = 3").withColumn("id", F.col("id") + 100000), "mark", 1.0)
    return P.append(points, more).select("id", "label", "mark")


_LAYOUT = "l AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CASE WHEN label = 3 THEN 1 ELSE 0 END AS flags FROM embeddings)"
_IN = "x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.2 AND 0.1"
for _mode, _case in {"set": f"CASE WHEN {_IN} THEN flags | 1 ELSE flags & ~1 END", "toggle": f"CASE WHEN {_IN} THEN xor(flags, 1) ELSE flags END", "remove": f"CASE WHEN {_IN} THEN flags & ~1 ELSE flags END"}.items():

    @query(f"rect_select_{_mode}", f"WITH {_LAYOUT} SELECT id, {_case} AS flags FROM l")
    def rect_select(spark, d, mode=_mode):
        return S.rectangle_select(layout(spark, d), (0.15, -0.2), (-0.1, 0.1), mode).select("id", "flags")


@query("unselect_all", "SELECT vec_id AS id, 0 AS flags FROM embeddings")
def unselect_all(spark, d):
    return S.unselect_all(panel(spark, d)).select("id", "flags")


_TEXTS = "t AS (SELECT DISTINCT text FROM documents WHERE doc_id % 7 = 0)"
for _mode, _case in {"import": "CASE WHEN t.text IS NOT NULL THEN flags | 1 ELSE flags & ~1 END", "select": "CASE WHEN t.text IS NOT NULL THEN flags | 1 ELSE flags END", "unselect": "CASE WHEN t.text IS NOT NULL THEN flags & ~1 ELSE flags END"}.items():

    @query(f"text_{_mode}", f"WITH {_TEXTS}, d AS (SELECT doc_id AS id, text, CAST(doc_id % 2 AS INT) AS flags FROM documents) SELECT id, {_case} AS flags FROM d LEFT JOIN t USING (text)")
    def text_select(spark, d, mode=_mode):
        docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 2).cast("int").alias("flags"))
        return S.select_texts(docs, docs.filter("id % 7 = 0"), mode).select("id", "flags")


@query("text_counts", "SELECT CAST(doc_id % 2 AS INT) AS selected, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def text_counts(spark, d):
    return S.text_counts(read(spark, d, "documents").select("text", (F.col("doc_id") % 2).cast("int").alias("flags")))


# --- functions --------------------------------------------------------------


@query("l2_norm", f"WITH {PTS}, n AS (SELECT id, f, sqrt(list_sum(list_transform(f, lambda v: v * v))) AS n FROM pts) SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS dim, round(unnest(f) / n, 6) + 0.0 AS x FROM n")
def l2_norm(spark, d):
    return rounded(to_cells(panel(spark, d).withColumn("features", vec.l2_normalise(F.col("features")))), "x")


@query("l1_norm", f"WITH {PTS}, n AS (SELECT id, f, list_sum(list_transform(f, lambda v: abs(v))) AS n FROM pts) SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS dim, round(abs(unnest(f)) / n, 6) + 0.0 AS x FROM n")
def l1_norm(spark, d):
    return rounded(to_cells(panel(spark, d).withColumn("features", vec.l1_normalise(F.transform("features", F.abs)))), "x")


@query("softmax", f"WITH {PTS}, n AS (SELECT id, f, list_sum(list_transform(f, lambda v: exp(v))) AS n FROM pts) SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS dim, round(exp(unnest(f)) / n, 6) + 0.0 AS x FROM n")
def softmax(spark, d):
    return rounded(to_cells(panel(spark, d).withColumn("features", vec.softmax(F.col("features")))), "x")


@query("vector_pair_functions", f"WITH {PTS} SELECT a.id, {r('list_inner_product(a.f, b.f)', 'dot')}, {r('list_distance(a.f, b.f)', 'l2')}, {r('list_sum(list_transform(range(1, 65), lambda k: abs(a.f[k] - b.f[k])))', 'l1')}, {r('a.f[1] + b.f[1]', 'first_sum')}, {r('a.f[1] * 2.5', 'first_scaled')} FROM pts a JOIN pts b ON b.id = a.id + 1")
def vector_pair_functions(spark, d):
    p = panel(spark, d)
    b = p.select((F.col("id") - 1).alias("id"), F.col("features").alias("g"))
    f, g = F.col("features"), F.col("g")
    out = p.join(b, "id").select("id", vec.dot(f, g).alias("dot"), vec.distance(f, g).alias("l2"), vec.manhattan(f, g).alias("l1"), vec.add(f, g)[0].alias("first_sum"), vec.scale(f, 2.5)[0].alias("first_scaled"))
    return rounded(out, "dot", "l2", "l1", "first_sum", "first_scaled")


_ABS = f"{PTS}, a AS (SELECT id, list_transform(f, lambda v: abs(v)) AS d FROM pts)"


@query("gaussian_row", f"WITH {_ABS}, g AS (SELECT id, list_transform(d, lambda v: exp(-(v * v) / (2 * 0.09))) AS g FROM a) SELECT id, CAST(generate_subscripts(g, 1) - 1 AS INT) AS dim, round(unnest(g) / list_sum(g), 6) + 0.0 AS x FROM g")
def gaussian_row(spark, d):
    return rounded(to_cells(panel(spark, d).withColumn("features", vec.gaussian(F.transform("features", F.abs), 0.3))), "x")


@query("gaussian_function", f"WITH {_ABS} SELECT id, {r('list_sum(list_transform(d, lambda v: 2.0 * exp(-(v * v) / (2 * 0.09))))', 'total')} FROM a")
def gaussian_function(spark, d):
    return rounded(panel(spark, d).select("id", vec.total(vec.gaussian_function(F.transform("features", F.abs), 0.3, 2.0)).alias("total")), "total")


@query("perplexity", f"WITH {_ABS}, p AS (SELECT id, list_transform(d, lambda v: v / list_sum(d)) AS p FROM a) SELECT id, {r('pow(2.0, -list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END)))', 'perplexity', 5)} FROM p")
def perplexity(spark, d):
    return rounded(panel(spark, d).select("id", vec.perplexity(vec.l1_normalise(F.transform("features", F.abs))).alias("perplexity")), "perplexity", digits=5)


@query("staleness", "SELECT event_id AS id, round(greatest(0.0, least(1.0, 1.0 - (9000.0 - event_id) / 500.0)), 6) + 0.0 AS confidence FROM events")
def staleness(spark, d):
    return rounded(read(spark, d, "events").select(F.col("event_id").alias("id"), vec.staleness(F.lit(9000.0), F.col("event_id")).alias("confidence")), "confidence")


# --- layouts ----------------------------------------------------------------

_DBOX = f"{DRAWING}, box AS (SELECT min(y0) AS a0, max(y0) AS b0, min(y1) AS a1, max(y1) AS b1 FROM drawing)"


def _xy(embedding):
    return rounded(embedding.select("id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1")


@query("zero_center", f"WITH {_DBOX} SELECT id, {r('y0 - (a0 + b0) / 2', 'y0')}, {r('y1 - (a1 + b1) / 2', 'y1')} FROM drawing, box")
def zero_center(spark, d):
    return _xy(P.zero_centre(drawing(spark, d)))


@query("scale_if_smaller", f"WITH {_DBOX} SELECT id, {r('(y0 - (a0 + b0) / 2) * 10 / (b0 - a0)', 'y0')}, {r('(y1 - (a1 + b1) / 2) * 10 / (b0 - a0)', 'y1')} FROM drawing, box")
def scale_if_smaller(spark, d):
    return _xy(P.scale_to(drawing(spark, d), 10.0, smaller=True))


@query("scale_if_bigger", f"WITH {_DBOX} SELECT id, {r('(y0 - (a0 + b0) / 2) * 1 / (b0 - a0)', 'y0')}, {r('(y1 - (a1 + b1) / 2) * 1 / (b0 - a0)', 'y1')} FROM drawing, box")
def scale_if_bigger(spark, d):
    return _xy(P.scale_to(drawing(spark, d), 1.0, smaller=False))


@query("remap_1d", f"WITH {_DBOX} SELECT id, 1.5 AS y0, {r('10 + (y0 - a0) / (b0 - a0) * 5', 'y1')} FROM drawing, box")
def remap_1d(spark, d):
    return _xy(P.remap_vertical(drawing(spark, d).select("id", F.array(F.col("y")[0]).alias("y")), (1.0, 2.0, 10.0, 15.0)))


@query("remap_2d", f"WITH {_DBOX}, m AS (SELECT *, greatest(b0 - a0, b1 - a1) AS m FROM box) SELECT id, {r('-1 + ((y0 - a0) / m + (1 - (b0 - a0) / m) / 2) * 2', 'y0')}, {r('((y1 - a1) / m + (1 - (b1 - a1) / m) / 2) * 3', 'y1')} FROM drawing, m")
def remap_2d(spark, d):
    return _xy(P.remap_box(drawing(spark, d), (-1.0, 1.0, 0.0, 3.0)))


@query("remap_2d_stretch", f"WITH {_DBOX} SELECT id, {r('-1 + (y0 - a0) / (b0 - a0) * 2', 'y0')}, {r('(y1 - a1) / (b1 - a1) * 3', 'y1')} FROM drawing, box")
def remap_2d_stretch(spark, d):
    return _xy(P.remap_box(drawing(spark, d), (-1.0, 1.0, 0.0, 3.0), fix_aspect=False))


@query("bbox", f"WITH {_DBOX} SELECT 0 AS dim, round(a0, 6) + 0.0 AS lo, round(b0, 6) + 0.0 AS hi FROM box UNION ALL SELECT 1, round(a1, 6) + 0.0, round(b1, 6) + 0.0 FROM box")
def bbox(spark, d):
    return rounded(P.bbox(drawing(spark, d)), "lo", "hi")


@query("bbox_padded", f"WITH {_DBOX}, h AS (SELECT *, greatest(b0 - a0, b1 - a1) * 1.1 / 2 / 0.9 AS h FROM box) SELECT 0 AS dim, {r('(a0 + b0) / 2 - h', 'lo')}, {r('(a0 + b0) / 2 + h', 'hi')} FROM h UNION ALL SELECT 1, {r('(a1 + b1) / 2 - h', 'lo')}, {r('(a1 + b1) / 2 + h', 'hi')} FROM h")
def bbox_padded(spark, d):
    return rounded(P.bbox(drawing(spark, d), 0.1), "lo", "hi")
