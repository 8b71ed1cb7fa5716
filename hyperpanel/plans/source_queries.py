"""Queries over files: tables are written in each format, read back, and compared with what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hsne as H
from ..operators import panel as P
from ..operators import session as S
from ..sources import binary, files, tables, text_formats
from .analysis_queries import _AREA, _BIP, _bipartite, hierarchy
from .panel_queries import r
from .registry import edges, edges_sql, layout, panel, query, read, rounded, transition, transition_sql

_AT = "row_number() OVER (ORDER BY vec_id) - 1"


def _x(name: str, dim: int) -> str:
    return f"CAST(embedding[{dim + 1}] AS DOUBLE) AS {name}"


def _first_two(points, column="features"):
    return points.select("id", F.col(column)[0].alias("x0"), F.col(column)[1].alias("x1"))


@query("matrix_file", f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def matrix_file(spark, d):
    p, path = panel(spark, d), files.folder(spark, "matrix")
    binary.write_matrix(p, path)
    return binary.read_matrix(spark, path, p.count(), 64).select("id", F.posexplode("features").alias("dim", "x"))


@query("embedding_file", f"SELECT {_AT} AS id, {_x('x0', 0)}, {_x('x1', 1)} FROM embeddings")
def embedding_file(spark, d):
    path = files.folder(spark, "positions")
    binary.write_matrix(layout(spark, d).select("id", F.array("x", "y").alias("y")), path, "y")
    return _first_two(binary.read_embedding(spark, path), "y")


@query("distance_matrix_file", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, pow((a.n_nationkey * 7 + b.n_nationkey * 3) % 11, 2) AS d2 FROM nation a, nation b")
def distance_matrix_file(spark, d):
    rows, path = read(spark, d, "nation"), files.folder(spark, "distances")
    n = rows.count()
    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: ((F.col("n_nationkey") * 7 + j * 3) % 11).cast("double"))
    binary.write_matrix(rows.select(F.col("n_nationkey").alias("id"), values.alias("features")), path)
    return binary.read_distance_matrix(spark, path, n)


for _kind in ("u1", "f4"):

    @query(f"labelled_matrix_{_kind}", f"SELECT {_AT} AS id, label, {_x('x0', 0)}, {_x('x1', 1)} FROM embeddings")
    def labelled_matrix(spark, d, kind=_kind):
        p, path = panel(spark, d), files.folder(spark, "labelled")
        binary.write_matrix(p, f"{path}/data")
        binary.write_vector(p, f"{path}/labels", "label", kind=kind, counted=False)
        found = binary.read_labelled_matrix(spark, f"{path}/data", f"{path}/labels", p.count(), 64, kind)
        return found.select("id", "label", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@query("idx_files", f"""WITH p AS (SELECT vec_id, label, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: 255 - floor((v + 1) * 127))) AS total FROM embeddings)
 SELECT row_number() OVER (ORDER BY label <> 1, vec_id) - 1 AS id, label, CASE WHEN label = 3 THEN 1 ELSE 0 END AS flags, total FROM p""")
def idx_files(spark, d):
    p, path = panel(spark, d), files.folder(spark, "idx")
    pixels = p.select("id", F.transform("features", lambda v: F.floor((v + 1) * 127).cast("double")).alias("features"), "label")
    binary.write_idx(pixels, f"{path}/images", f"{path}/labels", 8, 8)
    found = binary.read_idx(spark, f"{path}/images", f"{path}/labels", p.count(), select=3)
    return found.select("id", "label", "flags", F.aggregate("features", F.lit(0.0), lambda s, v: s + v).alias("total"))


def _voxels(spark, d):
    return panel(spark, d).select("id", (F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 7).cast("int").alias("y"), F.col("id").cast("int").alias("z"), "features")


@query("volume_file", f"SELECT {_AT} AS id, CAST(vec_id % 10 AS INT) AS x, CAST(vec_id % 7 AS INT) AS y, CAST(vec_id AS INT) AS z, {_x('x0', 5)}, {_x('x1', 0)} FROM embeddings")
def volume_file(spark, d):
    path = files.folder(spark, "volume")
    binary.write_volume(_voxels(spark, d), f"{path}/v.hdvol")
    return binary.read_volume(spark, f"{path}/v.hdvol", [5, 0]).select("id", "x", "y", "z", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@query("labelled_volume", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS dim, n_name AS label, 'ch' || n_nationkey AS path, (SELECT count(*) FROM embeddings) AS voxels FROM nation")
def labelled_volume(spark, d):
    path = files.folder(spark, "volume")
    binary.write_volume(_voxels(spark, d), f"{path}/v.hdvol")
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("ch"), F.col("n_nationkey").cast("string"), F.lit(","), "n_name").alias("line"))
    files.write_lines(names, "line", ["id"], f"{path}/labels.csv", "path,label\n")
    volume, dims = binary.read_labelled_volume(spark, f"{path}/v.hdvol", f"{path}/labels.csv")
    return dims.crossJoin(F.broadcast(volume.agg(F.count(F.lit(1)).alias("voxels"))))  # one row


@query("named_matrix", f"SELECT {_AT} AS id, 'img' || vec_id || '.png' AS path, 'c' || label AS label, {_x('x0', 0)}, {_x('x1', 1)} FROM embeddings")
def named_matrix(spark, d):
    p, path = panel(spark, d), files.folder(spark, "named")
    binary.write_matrix(p, f"{path}/data")
    lines = p.select("id", F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".png,c"), F.col("label").cast("string")).alias("line"))
    files.write_lines(lines, "line", ["id"], f"{path}/names.csv", "path,label\n")
    found = binary.read_named_matrix(spark, f"{path}/data", f"{path}/names.csv", p.count(), 64)
    return found.select("id", "path", "label", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@query("image_list", f"SELECT {_AT} AS id, 'img' || vec_id || '.png' AS path, {_x('x0', 0)}, {_x('x1', 1)} FROM embeddings")
def image_list(spark, d):
    p, path = panel(spark, d), files.folder(spark, "listed")
    binary.write_matrix(p, f"{path}/data")
    files.write_lines(p.select("id", F.concat(F.lit("img"), F.col("id").cast("string"), F.lit(".png")).alias("line")), "line", ["id"], f"{path}/list", f"{p.count()}\n")
    found = binary.read_image_list(spark, f"{path}/list", f"{path}/data")
    return found.select("id", "path", F.col("features")[0].alias("x0"), F.col("features")[1].alias("x1"))


@query("follower_files", "SELECT 'r' || n_regionkey AS target, n_name AS follower FROM nation")
def follower_files(spark, d):
    path = files.folder(spark, "followers")
    rows = read(spark, d, "nation").select("n_regionkey", "n_name")
    for key in (x.n_regionkey for x in rows.select("n_regionkey").distinct().collect()):  # a file a region
        files.write_lines(rows.filter(F.col("n_regionkey") == key), "n_name", ["n_name"], f"{path}/r{key}.txt")
    m, targets, followers = text_formats.read_followers(spark, path)
    named = m.join(targets.select(F.col("name").alias("target"), F.col("number").alias("a")), "a").join(followers.select(F.col("name").alias("follower"), F.col("number").alias("b")), "b")
    return named.select("target", "follower")


@query("projection_file", f"WITH f AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS n FROM embeddings GROUP BY label) SELECT {_AT} AS id, CAST(vec_id AS DOUBLE) AS x, CAST(vec_id * 2 AS DOUBLE) AS y, CAST(f.n AS INT) AS label, CAST(vec_id % 2 AS INT) AS pivot FROM embeddings JOIN f USING (label)")
def projection_file(spark, d):
    path = files.folder(spark, "projection")
    line = F.concat_ws(" ", F.col("id").cast("string"), (F.col("id") * 2).cast("string"), F.concat(F.lit("c"), F.col("label").cast("string")), (F.col("id") % 2).cast("string"))
    files.write_lines(panel(spark, d).select("id", line.alias("line")), "line", ["id"], f"{path}/p.txt")
    return text_formats.read_projection(spark, f"{path}/p.txt")


@query("colours_file", f"SELECT {_AT} AS id, " + ", ".join(r(f"(vec_id * {k + 3}) % 256 / 255.0", c) for k, c in enumerate("rgb")) + " FROM embeddings")
def colours_file(spark, d):
    p, path = panel(spark, d), files.folder(spark, "colours")
    line = F.concat_ws(",", *((F.col("id") * (k + 3) % 256).cast("string") for k in range(3)))
    files.write_lines(p.select("id", line.alias("line")), "line", ["id"], f"{path}/c.csv")
    return rounded(text_formats.read_colours(spark, f"{path}/c.csv", p.count()), "r", "g", "b")


@query("pixels_as_points", "SELECT row_number() OVER (ORDER BY vec_id // 32, vec_id % 32) - 1 AS id, CAST(vec_id // 32 AS DOUBLE) AS x0, CAST(vec_id % 32 AS DOUBLE) AS x1 FROM embeddings WHERE vec_id * 37 % 256 > 100")
def pixels_as_points(spark, d):
    pixels = panel(spark, d).select(F.call_function("div", F.col("id"), F.lit(32)).alias("row"), (F.col("id") % 32).alias("column"), (F.col("id") * 37 % 256).alias("r"))
    return _first_two(binary.pixels_as_points(pixels, F.col("r") > 100))


@query("cube_to_volume", f"""WITH c AS (SELECT vec_id, unnest(range(10)) AS k, embedding FROM embeddings), v AS (SELECT vec_id, k, CAST(embedding[CAST(floor(64 / 10.0 * k) AS INT) + 1] AS DOUBLE) AS v FROM c)
 SELECT row_number() OVER (ORDER BY vec_id // 16, vec_id % 16, k) // 10 * 0 + dense_rank() OVER (ORDER BY vec_id // 16, vec_id % 16) - 1 AS id, CAST(vec_id % 16 AS INT) AS x, CAST(vec_id // 16 AS INT) AS y, CAST(k AS INT) AS dim, v,
 {r('(SELECT avg(CASE WHEN v = (SELECT max(v) FROM v) THEN 1.0 ELSE 0.0 END) FROM v)', 'saturated')} FROM v""")
def cube_to_volume(spark, d):
    cube = panel(spark, d).select(F.call_function("div", F.col("id"), F.lit(16)).alias("row"), (F.col("id") % 16).alias("column"), "features")
    volume, shares = binary.cube_to_volume(cube, 10)
    return rounded(volume.select("id", "x", "y", F.posexplode("features").alias("dim", "v")).crossJoin(F.broadcast(shares.select("saturated"))), "saturated")  # one row


@query("sparse_file", f"WITH {edges_sql()} SELECT i, j, (i * 31 + j * 17) % 64 / 64.0 AS w FROM edges")
def sparse_file(spark, d):
    path = files.folder(spark, "sparse")
    e = edges(spark, d).select("i", "j", ((F.col("i") * 31 + F.col("j") * 17) % 64 / 64.0).alias("w"))
    binary.write_sparse(e, e.agg(F.max("i") + 1).first()[0], f"{path}/m")
    return binary.read_sparse(spark, f"{path}/m")


@query("vector_files", " UNION ALL ".join(f"SELECT '{k}' AS kind, {_AT} AS id, CAST({v} AS DOUBLE) AS v FROM embeddings" for k, v in (("f4", "embedding[1]"), ("u4", "label"), ("i4", "-label"))))
def vector_files(spark, d):
    p, path, out = panel(spark, d), files.folder(spark, "vectors"), None
    for kind, value in (("f4", F.col("features")[0]), ("u4", F.col("label").cast("double")), ("i4", -F.col("label").cast("double"))):
        binary.write_vector(p.select("id", value.alias("v")), f"{path}/{kind}", kind=kind)
        got = binary.read_vector(spark, f"{path}/{kind}", kind).select(F.lit(kind).alias("kind"), "id", "v")
        out = got if out is None else out.unionByName(got)
    return out


@query("nested_file", "SELECT DISTINCT l_suppkey AS id, l_partkey AS member FROM lineitem")
def nested_file(spark, d):
    path = files.folder(spark, "nested")
    m = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    binary.write_nested(m, m.agg(F.max("a") + 1).first()[0], f"{path}/n")
    return binary.read_nested(spark, f"{path}/n").select("id", F.explode("members").alias("member"))


@query("hierarchy_folder", f"WITH {_AREA} SELECT 0 AS scale, id AS lm, 1.0 AS weight FROM pts UNION ALL SELECT DISTINCT 1, lm, 3.0 FROM a1 UNION ALL SELECT DISTINCT 2, lm, 3.0 FROM b1")
def hierarchy_folder(spark, d):
    """A hierarchy whose landmarks all weigh 3, stored and loaded: points weigh 1 again."""
    h, path, out = hierarchy(spark, d), files.folder(spark, "hierarchy"), None
    for s in h.scales:
        s.landmarks = s.landmarks.withColumn("weight", F.lit(3.0))
    tables.save_hierarchy(h, path)
    for k, s in enumerate(tables.load_hierarchy(spark, path).scales):
        got = s.landmarks.select(F.lit(k).alias("scale"), "lm", "weight")
        out = got if out is None else out.unionByName(got)
    return out


@query("session_folder", f"WITH {_BIP} SELECT 'links' AS part, a, b, n FROM con UNION ALL SELECT 'dominant', lm, id, 1 FROM da")
def session_folder(spark, d):
    m, a, b = _bipartite(spark, d)
    path = files.folder(spark, "session")
    tables.save_session({"links": S.connections(a, m, b), "dominant": a.select(F.col("lm").alias("a"), F.col("id").alias("b"), F.lit(1).cast("long").alias("n"))}, path)
    got = tables.load_session(spark, ["links", "dominant"], path)
    return got["links"].select(F.lit("links").alias("part"), "a", "b", "n").unionByName(got["dominant"].select(F.lit("dominant").alias("part"), "a", "b", "n"))


@query("probability_cache", f"WITH {transition_sql()} SELECT i, j, {r('w', 'w')} FROM t")
def probability_cache(spark, d):
    """Transition rows, built the first time and read the second."""
    path = files.folder(spark, "cache")
    tables.cached(spark, path, {"k": 5}, lambda: transition(spark, d))
    return rounded(tables.cached(spark, path, {"k": 5}, lambda: transition(spark, d).limit(0)), "w")


@query("analysis_folder", f"SELECT vec_id AS id, {r('CAST(embedding[1] AS DOUBLE)', 'x')}, {r('CAST(embedding[2] AS DOUBLE)', 'y')}, CAST(label AS DOUBLE) AS w, 7 AS parent, (SELECT count(*) FROM embeddings) AS size FROM embeddings")
def analysis_folder(spark, d):
    p, path = panel(spark, d), files.folder(spark, "analysis")
    drawn = p.select("id", F.array(F.col("features")[0], F.col("features")[1]).alias("y"), F.col("label").cast("double").alias("w"))
    text_formats.export_analysis(drawn, p.filter("flags = 1").select("id"), 7, path)
    info = spark.read.csv(f"{path}/info", header=True, schema="parent long, size long")  # one row
    return rounded(spark.read.csv(f"{path}/embedding", header=True, schema="x double, y double, w double, id long").crossJoin(F.broadcast(info)), "x", "y")


@query("selected_texts_file", "SELECT n_name AS text FROM nation WHERE n_regionkey = 1")
def selected_texts_file(spark, d):
    path = files.folder(spark, "texts")
    rows = read(spark, d, "nation").select(F.col("n_name").alias("text"), (F.col("n_regionkey") == 1).cast("int").alias("flags"))
    text_formats.write_selected_texts(rows, f"{path}/texts")
    return text_formats.read_lines_as_texts(spark, f"{path}/texts")


@query("point_property", "SELECT vec_id AS id, 2.5 AS weight FROM embeddings")
def point_property(spark, d):
    p = P.with_property(panel(spark, d), "weight", 2.5)
    return p.select("id", P.property_of(p, "weight").alias("weight"))


@query("hierarchy_statistics", f"WITH {_AREA}, e AS (SELECT count(*) AS n FROM (SELECT 1 FROM embeddings, range(5))) SELECT scale, landmarks, n AS transitions, influences, CAST(landmarks AS DOUBLE) AS weight FROM e, (SELECT 0 AS scale, (SELECT count(*) FROM pts) AS landmarks, 0 AS influences UNION ALL SELECT 1, (SELECT count(DISTINCT lm) FROM a1), (SELECT count(*) FROM a1) UNION ALL SELECT 2, (SELECT count(DISTINCT lm) FROM b1), (SELECT count(*) FROM b1))")
def hierarchy_statistics(spark, d):
    return H.statistics(hierarchy(spark, d))


@query("scale_view", f"WITH {_AREA} SELECT DISTINCT lm AS id, 1.0 AS weight FROM b1")
def scale_view(spark, d):
    """The top scale as a view: its points with their weights."""
    ids, _, weights = S.view_of(hierarchy(spark, d))
    return ids.join(weights, "id")


@query("kept_partners", f"WITH {_BIP}, v AS (SELECT b AS id, sum(CASE WHEN a IN (1, 3) THEN n ELSE 0 END) / sum(n) AS v FROM con GROUP BY b) SELECT id, {r('v', 'v')} FROM v WHERE v > 0.3")
def kept_partners(spark, d):
    m, a, b = _bipartite(spark, d)
    chosen = a.select(F.col("lm").alias("id")).distinct().filter("id IN (1, 3)")
    linked = S.linked_selection(S.connections(a, m, b), chosen).withColumnRenamed("b", "id")
    return rounded(S.kept_partners(linked).select("id", "v"), "v")


@query("word_cloud_json", "SELECT '{\"text\":\"' || n_name || '\",\"size\":' || n_regionkey || '.0}' AS json FROM nation")
def word_cloud_json(spark, d):
    return S.word_cloud_json(read(spark, d, "nation").select(F.col("n_name").alias("text"), F.col("n_regionkey").cast("double").alias("size")))


@query("cluster_tree", f"WITH {_AREA} SELECT 2 AS scale, 0 AS cluster_id, -1 AS parent_id UNION ALL SELECT DISTINCT 1, CAST(lm // 25 AS INT), 0 FROM a1 WHERE lm // 25 <> 3")
def cluster_tree(spark, d):
    """A root and its clusters, added one by one; one is removed."""
    h = hierarchy(spark, d)
    tree = H.add_cluster(spark.createDataFrame([], "scale int, cluster_id int, parent_id int, notes string"), 2, 0, None, 2)
    groups = h.scales[1].landmarks.select(F.call_function("div", F.col("lm"), F.lit(25)).cast("int").alias("cluster_id")).distinct()
    more = groups.select(F.lit(1).alias("scale"), "cluster_id", F.lit(0).alias("parent_id"), F.lit(None).cast("string").alias("notes"))
    return H.remove_cluster(tree.select("scale", "cluster_id", "parent_id", "notes").unionByName(more), 1, 3).select("scale", "cluster_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))
