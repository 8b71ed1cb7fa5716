"""Small fixtures with known results, and invariants of what has no SQL."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperpanel.functions import calibrate, vec
from hyperpanel.operators import analysis, embedding, graphs, hsne, knn, panel, sets, similarity, tree
from hyperpanel.sources import binary, tables, text_formats


def points(spark, rows):
    return spark.createDataFrame([(k, [float(v) for v in r], 0) for k, r in enumerate(rows)], "id long, features array<double>, flags int")


def edges(spark, rows):
    return spark.createDataFrame([(i, j, float(w)) for i, j, w in rows], "i long, j long, w double")


def test_histogram(spark):
    values = spark.createDataFrame([(float(v),) for v in (5, 1, 2, 3, 5, 5, 0, 10, 200, -10, 5.5)], "v double")
    counts = {r.bucket: r.cnt for r in panel.histogram(values, "v", 0.0, 10.0, 10).collect()}
    assert sum(counts.values()) == 9 and counts[5] == 4 and counts[9] == 1 and counts[1] == 1 and counts[0] == 1


def test_distances_and_ties(spark):
    p = points(spark, [(0, 0, 0), (1, 1, 1), (2, 2, 2), (1, 1, 1)])
    near = {(r.i, r.rk): (r.j, r.d2) for r in knn.knn(p, 3).collect()}
    assert near[0, 1] == (1, 3.0) and near[0, 2] == (3, 3.0) and near[0, 3] == (2, 12.0)
    assert near[1, 1] == (3, 0.0)
    assert sorted(knn.knn(p, 3).collect()) == sorted(knn.knn(p, 3, method="sql").collect()) == sorted(knn.knn(p, 3, method="blocks").collect())


@pytest.mark.parametrize("f", [lambda k: math.sin(3.1415 * k / 100) ** 2, lambda k: math.cos(3.1415 * k / 100) ** 2])
def test_gaussians_sum_to_one(spark, f):
    row = spark.createDataFrame([([f(k) for k in range(100)],)], "d array<double>")
    assert abs(row.select(vec.total(vec.gaussian(F.col("d"), 1.0))).first()[0] - 1) < 1e-5
    fit = calibrate.beta(F.col("d"), 30.0)
    p = row.select(calibrate.probabilities(F.col("d"), fit).alias("p")).select("p", vec.perplexity(F.col("p")).alias("x")).first()
    assert abs(sum(p.p) - 1) < 1e-5 and abs(p.x - 30) < 0.01
    q, _ = calibrate.kernel(np.array([[f(k) for k in range(100)]]), 30.0)
    assert np.allclose(q[0], p.p, atol=1e-6)


def test_perplexity(spark):
    rows = spark.createDataFrame([([0.1] * 10, 10.0), ([1.0] + [0.0] * 9, 1.0), ([0.2] * 5, 5.0)], "p array<double>, x double")
    for r in rows.select(vec.perplexity(F.col("p")).alias("got"), "x").collect():
        assert abs(r.got - r.x) < 1e-4


def test_normalisation_of_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(vec.l2_normalise(F.col("a")).alias("b"), vec.l1_normalise(F.col("a")).alias("c")).first()
    assert row.b == [0.5, 0.5] and row.c == [0.5, 0.5]


def test_chain(spark):
    t = edges(spark, [(0, 0, 0.5), (0, 1, 0.25), (0, 2, 0.25), (1, 1, 1), (2, 2, 1)])
    v = spark.createDataFrame([(0, 1.0)], "id long, a double")
    for steps, want in ((1, (0.5, 0.25, 0.25)), (2, (0.25, 0.375, 0.375)), (3, (0.125, 0.4375, 0.4375)), (40, (0, 0.5, 0.5))):
        got = {r.id: r.a for r in graphs.power_iteration(v, t, steps).collect()}
        assert all(abs(got.get(k, 0) - w) < 1e-4 for k, w in enumerate(want))


def test_components_take_edges_both_ways(spark):
    nodes = spark.range(7)
    got = {r.node: (r.component, r.size) for r in graphs.components(edges(spark, [(1, 0, 1), (2, 1, 1), (5, 4, 1), (3, 2, 0.0)]), nodes).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 1)}


def test_walks_are_reproducible_and_stop(spark):
    t = edges(spark, [(0, 1, 1), (1, 2, 0.5), (1, 3, 0.5)])
    starts = spark.createDataFrame([(0,)], "id long")
    stops = spark.createDataFrame([(2,)], "id long")
    a = sorted(graphs.absorbing_walks(t, starts, stops, 50, 5, seed=1).collect())
    assert a == sorted(graphs.absorbing_walks(t, starts, stops, 50, 5, seed=1).collect())
    assert {r["at"] for r in a} == {2, None} and len(a) == 50


def test_exact_areas_bound_sampled_ones(spark):
    t = edges(spark, [(0, 1, 0.5), (0, 2, 0.5), (1, 0, 1), (2, 0, 1)])
    nodes, stops = spark.range(3), spark.createDataFrame([(2,)], "id long")
    exact = {r.prev: r.p for r in hsne.exact_areas(t, nodes, stops, 12).collect()}
    assert abs(exact[0] - (1 - 0.5**6)) < 1e-9


def test_joint_probabilities(spark):
    rng = np.random.default_rng(1)
    p = points(spark, rng.normal(size=(60, 4)))
    joint = {(r.i, r.j): r.w for r in similarity.joint(p, similarity.Parameters(perplexity=5)).collect()}
    assert abs(sum(joint.values()) - 60) < 1e-6 and all(abs(joint[j, i] - w) < 1e-12 for (i, j), w in joint.items())


def test_sets(spark):
    s = spark.createDataFrame([(0, [1, 2, 2]), (1, [2, 1]), (2, []), (3, [9])], "id long, members array<long>")
    assert sorted((r.id, r.n) for r in sets.deduplicated(s).collect()) == [(0, 2), (2, 1), (3, 1)]
    near = [(r.i, r.j, r.d2) for r in sets.jaccard_knn(s, 2).orderBy("i", "rk").collect()]
    assert [x for x in near if x[2] < 1] == [(0, 1, 0.0), (1, 0, 0.0)]
    # sets with fewer than k overlapping ones are filled up to k at distance 1, by id
    assert [x for x in near if x[2] == 1] == [(0, 2, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0), (3, 1, 1.0)]


def test_kmeans_keeps_empty_centroids(spark):
    p = points(spark, [(0, 0), (1, 0), (10, 0)])
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 0.0]), (2, [50.0, 50.0])], "c int, centre array<double>")
    assert {r.c: r.centre for r in analysis.kmeans_step(p, c).collect()} == {0: [0.5, 0.0], 1: [10.0, 0.0], 2: [50.0, 50.0]}


def test_empty_selection_has_no_profile(spark):
    assert panel.selection_profile(points(spark, [(1, 2), (3, 4)])).count() == 0


def test_tree_equals_exact_forces():
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(size=(200, 2)), [[0.5, 0.5]] * 3])
    w = rng.uniform(0.5, 2, len(y))
    f, z = embedding._repulsion(y, w, embedding.Parameters())
    t = tree.Tree(y, w)
    assert t.check()
    g, x = t.repulsion(y, w, 1e-9)
    assert np.allclose(f, g, atol=1e-7) and abs(z - x) < 1e-6 * z
    h, v = t.repulsion(y, w, 0.5)
    assert abs(v - z) < 0.03 * z and np.abs(h - f).max() < 0.1 * np.abs(f).max()


def test_field_is_near_exact():
    y = np.random.default_rng(3).normal(size=(300, 2)) * 4
    f, z = embedding._repulsion(y, np.ones(300), embedding.Parameters())
    g, x = embedding._repulsion(y, np.ones(300), embedding.Parameters(repulsion="field"))
    assert abs(x - z) < 0.1 * z and np.corrcoef(f.ravel(), g.ravel())[0, 1] > 0.98


@pytest.mark.parametrize("p", [embedding.Parameters(exaggeration_stop=20, exaggeration_decay=10), embedding.Parameters(theta=0.5, exaggeration_stop=20, exaggeration_decay=10), embedding.Parameters(repulsion="field", exaggeration_stop=20, exaggeration_decay=10)])
def test_embedding_lowers_divergence(spark, p):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(size=(30, 5)) + 8 * k for k in range(3)])
    pts = points(spark, data)
    joint = similarity.joint(pts, similarity.Parameters(perplexity=6))
    state, i, j, w, _ = embedding._local(embedding.initial(pts, p), joint, None)
    before = embedding.divergence(state.y, i, j, w)
    for _ in range(120):
        state = embedding.iterate(state, i, j, w, p)
    assert embedding.divergence(state.y, i, j, w) < before - 0.5
    near = np.argsort(((state.y[:, None] - state.y[None]) ** 2).sum(-1), axis=1)[:, 1:6]
    assert (near // 30 == np.arange(90)[:, None] // 30).mean() > 0.9


def test_hierarchy_round_trip_and_weights(spark, tmp_path):
    pts = points(spark, np.random.default_rng(5).normal(size=(120, 3)))
    h = hsne.add_scale(hsne.from_points(pts, hsne.Parameters(neighbours=9, walks=6, walk_length=4, walks_per_landmark=20, max_jumps=20)))
    total = h.scales[1].landmarks.agg(F.sum("weight")).first()[0]
    assert 0 < total <= 120 + 1e-6
    rows = h.scales[1].transition.groupBy("i").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in rows)
    tables.save_hierarchy(h, str(tmp_path / "h"))
    back = tables.load_hierarchy(spark, str(tmp_path / "h"))
    assert back.scales[1].landmarks.count() == h.scales[1].landmarks.count() and back.top == 1


def test_cluster_ids(spark):
    c = spark.createDataFrame([(1, 0), (1, 2)], "scale int, cluster_id int")
    assert hsne.free_cluster_id(c, 1) == 1 and hsne.free_cluster_id(c, 0) == 0
    with pytest.raises(ValueError):
        hsne.checked_cluster(c, 0, 5, None, 1)


def test_properties(spark):
    p = panel.with_property(points(spark, [(1, 2)]), "Test")
    assert p.select("Test").first()[0] == 0.0
    with pytest.raises(ValueError):
        panel.with_property(p, "Test")
    with pytest.raises(KeyError):
        panel.property_of(panel.without_property(p, "Test"), "Test")


def test_width_is_checked(spark):
    from hyperpanel.schema import with_width

    with pytest.raises(Exception, match="width"):
        with_width(points(spark, [(1, 2), (1, 2, 3)]), 2).collect()


def test_binary_round_trips(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "m").write_bytes(m.tobytes())
    p = binary.read_matrix(spark, str(tmp_path / "m"), 4, 3)
    assert binary.matrix_bytes(p) == m.tobytes()
    with pytest.raises(Exception, match="bytes"):
        binary.read_matrix(spark, str(tmp_path / "m"), 5, 3).collect()
    e = edges(spark, [(0, 1, 0.5), (2, 0, 0.25)])
    (tmp_path / "s").write_bytes(binary.sparse_bytes(e, 3))
    assert sorted(binary.read_sparse(spark, str(tmp_path / "s")).collect()) == sorted(e.collect())
    (tmp_path / "v").write_bytes(binary.volume_bytes(np.array([[0, 1, 2], [3, 4, 5]]), np.array([[1.0, 2.0], [3.0, 4.0]])))
    assert [(r.x, r.features) for r in binary.read_volume(spark, str(tmp_path / "v"), [1]).orderBy("id").collect()] == [(0, [2.0]), (3, [4.0])]
    (tmp_path / "n").write_bytes(binary.nested_bytes([[1, 2], [], [3]]))
    assert [r.members for r in binary.read_nested(spark, str(tmp_path / "n")).orderBy("id").collect()] == [[1, 2], [], [3]]
    (tmp_path / "u").write_bytes(binary.vector_bytes(np.array([1, 5]), "u4"))
    assert [r.v for r in binary.read_vector(spark, str(tmp_path / "u"), "u4").orderBy("id").collect()] == [1.0, 5.0]
    (tmp_path / "i").write_bytes(struct.pack(">4i", 0, 3, 1, 2) + bytes([0, 255, 10, 20, 1, 2]))
    (tmp_path / "l").write_bytes(struct.pack(">2i", 0, 3) + bytes([7, 1, 7]))
    idx = binary.read_idx(spark, str(tmp_path / "i"), str(tmp_path / "l"), 3, select=7).orderBy("id").collect()
    assert [(r.label, r.flags) for r in idx] == [(1, 0), (7, 1), (7, 1)] and idx[1].features == [255.0, 0.0]


def test_text_formats(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("u\nv\n")
    (tmp_path / "f/b.txt").write_text("v\nw\n")
    members, targets, followers = text_formats.read_followers(spark, str(tmp_path / "f"))
    assert members.count() == 4 and targets.count() == 2 and followers.count() == 3
    (tmp_path / "p").write_text("0 1 x 0\n2 3 y 1\n4 5 x 0\n")
    assert [r.label for r in text_formats.read_projection(spark, str(tmp_path / "p")).orderBy("id").collect()] == [0, 1, 0]
    (tmp_path / "c").write_text("255,0,0,0,255,0,0")
    assert [(r.r, r.g, r.b) for r in text_formats.read_colours(spark, str(tmp_path / "c"), 2).orderBy("id").collect()] == [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    text_formats.write_dy(points(spark, [(1, 2)]).withColumn("label", F.lit(3)), "label", str(tmp_path / "dy"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dy")).collect()]
    assert "P0;1.0;2.0;3.0" in lines and "DY" in lines


def test_progressive_run(spark):
    from hyperpanel.streaming import progressive

    pts = points(spark, np.random.default_rng(6).normal(size=(40, 3)))
    joint = similarity.joint(pts, similarity.Parameters(perplexity=4))
    seen = [(t, len(f)) for t, f in progressive.generate(embedding.initial(pts, embedding.Parameters()), joint, iterations=20, every=10)]
    assert seen == [(10, 40), (20, 40)]


def test_named_sources(spark, tmp_path):
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "m").write_bytes(m.tobytes())
    (tmp_path / "n.csv").write_text("path,label\na.png,x\nb.png,y\n")
    (tmp_path / "l").write_text("2\na.png\nb.png\n")
    assert [(r.path, r.label) for r in binary.read_named_matrix(spark, str(tmp_path / "m"), str(tmp_path / "n.csv"), 2, 3).orderBy("id").collect()] == [("a.png", "x"), ("b.png", "y")]
    assert [(r.path, r.features) for r in binary.read_image_list(spark, str(tmp_path / "l"), str(tmp_path / "m")).orderBy("id").collect()] == [("a.png", [0.0, 1.0, 2.0]), ("b.png", [3.0, 4.0, 5.0])]


def test_coupled_run_draws_partners_together(spark):
    from hyperpanel.operators import session

    ring = edges(spark, [(k, (k + 1) % 12, 1) for k in range(12)])
    ids = spark.range(12)
    links = spark.createDataFrame([(k, k, 1) for k in range(12)], "a long, b long, n long")
    last = None
    for t, y in session.coupled({"a": (ids, ring), "b": (ids, ring)}, links, iterations=30):
        last = t, y
    assert last[0] == 30 and len(last[1]["a"][1]) == 12


def test_cached_table_is_read_back(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path), {"k": 1}, build).count() == 3
    assert len(calls) == 1
