"""Queries and operators do the whole job: recall, all rows, all dimensions, walks that end."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import DATA

from hyperpanel.functions import calibrate
from hyperpanel.operators import analysis as A
from hyperpanel.operators import embedding, knn
from hyperpanel.operators import sets as J
from hyperpanel.operators.similarity import walk_weights
from hyperpanel.plans import QUERIES
from hyperpanel.plans.registry import panel


def pairs(df):
    return {(r.i, r.j) for r in df.select("i", "j").collect()}


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.1"])
def test_lsh_knn_recall(spark, folder):
    true = pairs(knn.knn(panel(spark, folder), 10))
    for found in (QUERIES["lsh_knn"](spark, folder), knn.lsh_knn(panel(spark, folder), 10)):
        share = len(pairs(found) & true) / len(true)
        print(folder, round(share, 3))
        assert share >= 0.9


def test_lsh_knn_of_full_recall_is_exact(spark):
    points = panel(spark, DATA).filter("id < 200")
    assert pairs(knn.lsh_knn(points, 10, recall=1.0)) == pairs(knn.knn(points, 10))


def vectors(folder=DATA):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    x = np.array(t.column("embedding").to_pylist(), float)
    return t.column("vec_id").to_numpy(), x, np.stack([((v - x) ** 2).sum(1) for v in x])


def test_radius_join_asks_all_points(spark):
    folder = "/root/testdata/sf0.1"  # no two points of the smaller ones are so near
    ids, _, d2 = vectors(folder)
    want = {(int(ids[a]), int(ids[b])): d2[a, b] for a, b in zip(*np.nonzero((d2 <= 0.8) & ~np.eye(len(ids), dtype=bool)), strict=True)}
    got = {(r.i, r.j): r.d2 for r in QUERIES["radius_join"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert max(i for i, _ in got) >= 100


@pytest.mark.parametrize("metric", ["l1", "l2", "l2sq"])
def test_radius_methods_agree(spark, metric):
    points = panel(spark, DATA).filter("id < 60")
    r = {"l1": 8.0, "l2": 1.3, "l2sq": 1.7}[metric]
    a, b = (knn.radius(points, points, r, metric, method=m).collect() for m in ("broadcast", "blocks"))
    near = {(x.i, x.j) for x in knn.knn(points, 59, metric).filter(f"d2 <= {r}").collect()}
    assert sorted(a) == sorted(b) and {(x.i, x.j) for x in a} == near and near


def test_conditional_p_column_of_all_points(spark):
    kernel, column = ({(r.i, r.j): r.w for r in QUERIES[n](spark, DATA).collect()} for n in ("conditional_p", "conditional_p_column"))
    assert kernel.keys() == column.keys() and all(abs(kernel[k] - column[k]) < 2e-4 for k in kernel)


def test_bundle_step_of_all_segments(spark):
    ids, x, d2 = vectors()
    np.fill_diagonal(d2, np.inf)
    pairs_ = [(i, j) for i in range(len(ids)) for j in np.lexsort((ids, d2[i]))[:2]]
    xy = np.array([[x[i, :2] + (x[j, :2] - x[i, :2]) * k / 5 for k in range(6)] for i, j in pairs_])
    gap = xy[None] - xy[:, None]
    pull = np.where(np.abs(gap) < 0.1, gap, 0).sum(1) * 0.1 / len(pairs_)
    want = xy.copy()
    want[:, 1:5] += (xy[:, :4] + xy[:, 2:] - 2 * xy[:, 1:5] + pull[:, 1:5]) * 0.15 * 0.98 * 0.15
    got = {(r.a, r.b, r.k): (r.x, r.y) for r in QUERIES["bundle_step"](spark, DATA).collect()}
    assert len(got) == 6 * len(pairs_)
    for n, (i, j) in enumerate(pairs_):
        for k in range(6):
            assert np.allclose(got[int(ids[i]), int(ids[j]), k], want[n, k], atol=2e-6)


def test_exact_tsne_embeds_all_labels(spark):
    ids, _, _ = vectors()
    got = QUERIES["exact_tsne_full"](spark, DATA).collect()
    assert {r.id for r in got} == set(ids.tolist()) and all(np.isfinite([r.y0, r.y1]).all() for r in got)


def test_all_distances_between_labels(spark):
    ids, _, d2 = vectors()
    t = QUERIES["all_distances"](spark, DATA).toArrow()
    place = {v: p for p, v in enumerate(ids.tolist())}
    i, j = ([place[v] for v in t.column(c).to_pylist()] for c in "ij")
    assert len(set(zip(i, j, strict=True))) == len(i) == len(ids) * (len(ids) - 1)
    assert np.abs(t.column("d2").to_numpy() - d2[i, j]).max() < 1e-6


def test_p_from_distance_matrix_of_all_points(spark):
    ids, _, d2 = vectors()
    got = np.zeros_like(d2)
    place = {v: p for p, v in enumerate(ids.tolist())}
    rows = QUERIES["p_from_distance_matrix"](spark, DATA).collect()
    for r in rows:
        got[place[r.i], place[r.j]] = r.w
    p, _ = calibrate.kernel(np.stack([np.delete(v, k) for k, v in enumerate(d2)]), 5.0)
    want = np.stack([np.insert(v, k, 0.0) for k, v in enumerate(p)])
    assert len(rows) == len(ids) ** 2 and np.abs(got - want).max() < 1e-3


def test_walks_go_on_until_they_meet_a_landmark(spark):
    # 0 and 9 are landmarks at the ends of a line; walks take some 81 steps, and 20 and 21 keep theirs
    rows = [(k, k + s, 0.5) for k in range(1, 9) for s in (-1, 1)] + [(0, 1, 1.0), (9, 8, 1.0), (30, 20, 0.5), (30, 0, 0.5), (20, 21, 1.0), (21, 20, 1.0)]
    graph = spark.createDataFrame(rows, "i long, j long, w double")
    landmarks = spark.createDataFrame([(0,), (9,), (30,)], "id long")
    assert {(r.i, r.j): round(r.w, 9) for r in embedding.meetings(graph, landmarks).collect()} == {(0, 9): 1.0, (9, 0): 1.0, (30, 0): 1.0}


@pytest.mark.parametrize("block", [1, 7, 128])
def test_first_meetings_equal_solved_chain(block):
    g = np.random.default_rng(0)
    p = g.random((60, 60)) * (g.random((60, 60)) < 0.2) + 1e-3
    p /= p.sum(1, keepdims=True)
    first = p[50:, 50:] + p[50:, :50] @ np.linalg.solve(np.eye(50) - p[:50, :50], p[:50, 50:])
    np.fill_diagonal(first, 0)
    assert np.allclose(embedding.met_first(p.copy(), 10, block), first / first.sum(1, keepdims=True))


def test_rw_tsne_full_relates_all_landmarks(spark):
    points = panel(spark, DATA)
    chosen = points.select("id").orderBy("id").limit(100)
    sums = embedding.meetings(walk_weights(points, 10), chosen).groupBy("i").sum("w").collect()
    assert len(sums) >= 99 and all(abs(r[1] - 1) < 1e-9 for r in sums)
    assert QUERIES["rw_tsne_full"](spark, DATA).count() == 100


def neighbourhoods(k):
    ids, x, d2 = vectors()
    np.fill_diagonal(d2, np.inf)
    for i in range(len(ids)):
        near = np.lexsort((ids, d2[i]))[:k]
        w = 1 / (1 + d2[i, near])
        yield int(ids[i]), np.cov(x[near].T, aweights=w, ddof=0)


def test_intrinsic_dim_of_all_dimensions(spark):
    got = {r.i: r.dimension for r in QUERIES["intrinsic_dim"](spark, DATA).collect()}
    want = {i: np.trace(c) / np.linalg.eigvalsh(c).max() for i, c in neighbourhoods(10)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    assert max(got.values()) > 3


def test_local_covariance_of_all_dimensions(spark):
    t = QUERIES["local_covariance"](spark, DATA).filter("i < 40").toArrow()
    want = dict(neighbourhoods(5))
    i, a, b, c = (t.column(n).to_numpy() for n in ("i", "a", "b", "c"))
    assert len(c) == 40 * 64 * 64 and max(abs(want[u][v, w] - y) for u, v, w, y in zip(i, a, b, c, strict=True)) < 1e-6


def test_covariance_far_from_zero(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(400, 5)) @ g.normal(size=(5, 5)) + 1e8
    w = g.integers(1, 5, 400).astype(float)
    points = spark.createDataFrame([(k, [float(v) for v in row], float(m)) for k, (row, m) in enumerate(zip(x, w, strict=True))], "id long, features array<double>, weight double").repartition(3)
    for weight, aw in ((None, np.ones(400)), ("weight", w)):
        got = np.zeros((5, 5))
        for r in A.covariance(points, weight).collect():
            got[r.a, r.b] = r.c
        assert np.abs(got - np.cov(x.T, aweights=aw, ddof=0)).max() < 1e-6
    assert A.covariance(points.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_jaccard_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(J, "ASK_MEMBERS", block)
    g = np.random.default_rng(1)
    sets = [sorted({int(v) for v in g.integers(0, 30, g.integers(0, 6))}) for _ in range(40)] + [[], [1, 1, 2]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(sets)], "id long, members array<long>").repartition(3)
    got = {(r.i, r.rk): (r.j, round(r.d2, 9)) for r in J.jaccard_knn(df, 6).collect()}
    for i, a in enumerate(sets):
        d = sorted((round(1 - len({*a} & {*b}) / max(1, len({*a} | {*b})), 9), j) for j, b in enumerate(sets) if j != i)
        assert [got[i, k + 1] for k in range(6)] == [(j, v) for v, j in d[:6]]
    assert J.jaccard_knn(df.limit(0), 3).count() == 0
