"""What the findings of the second round asked for, each at a size that shows it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from hyperpanel.operators import embedding, graphs, knn, session, sets, similarity


def test_repulsion_holds_a_tile_of_pairs():
    y = np.random.default_rng(0).normal(size=(6000, 2))
    tracemalloc.start()
    embedding._repulsion(y, np.ones(6000), embedding.Parameters())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20


def test_kernel_sums_across_tiles_leave_out_all_rows_of_an_id(spark):
    rng = np.random.default_rng(1)
    n = 2 * embedding.TILE_COLUMNS + 7
    ids, y = rng.permutation(np.arange(n) // 2), rng.normal(size=(n, 2)) * 3 + 50
    frame = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, y, strict=True)], "id long, y array<double>")
    gap = y[:, None] - y[None]
    q = np.where(ids[:, None] == ids[None], 0, 1 / (1 + (gap * gap).sum(-1)))
    want = sorted((int(i), *map(float, row)) for i, row in zip(ids, np.column_stack([q.sum(1), ((q * q)[:, :, None] * gap).sum(1)]), strict=True))
    got = sorted((r.id, r.z, *r.f) for r in embedding.kernel_sums(frame).collect())
    assert np.allclose(got, want, rtol=1e-10, atol=1e-10)


def test_neighbours_among_more_copies_than_candidates():
    rng = np.random.default_rng(2)
    x, ids = np.repeat(rng.normal(size=(5, 8)), 100, axis=0), rng.permutation(500)
    for metric in ("l1", "l2", "l2sq"):
        got = [np.concatenate(c) for c in zip(*knn._nearest(ids, x, ids, x, 4, metric), strict=True)]
        for row in range(0, 500, 50):
            d = knn._exact(x[row], x, metric)
            d[row] = np.inf
            assert got[1][got[0] == ids[row]].tolist() == ids[np.lexsort((ids, d))[:4]].tolist()


def _sets(spark, n, members, width):
    rng = np.random.default_rng(3)
    rows = [(i, sorted({int(v) for v in rng.integers(0, members, rng.integers(0, width))})) for i in range(n)]
    return dict(rows), spark.createDataFrame(rows, "id long, members array<long>")


def test_overlaps_are_counted_before_they_are_rows(spark):
    of, frame = _sets(spark, 120, 60, 9)
    both = {(i, j): len(set(a) & set(b)) for i, a in of.items() for j, b in of.items() if set(a) & set(b)}
    got = {(r.i, r.j): (r.inter, r.union_) for r in sets.overlaps(frame).collect()}
    assert got == {(i, j): (n, len(of[i]) + len(of[j]) - n) for (i, j), n in both.items() if i != j}
    two = {(r.i, r.j): r.inter for r in sets.overlaps(frame.filter("id < 50"), frame.filter("id >= 40")).collect()}
    assert two == {(i, j): n for (i, j), n in both.items() if i < 50 and j >= 40}
    assert "Join" not in sets.overlaps(frame)._jdf.queryExecution().executedPlan().toString()
    assert sets.overlaps(frame.limit(0)).count() == 0


def test_all_pairs_columns_sum_to_one_without_a_sort_of_pairs(spark):
    of, frame = _sets(spark, 80, 40, 7)
    w = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in of.items() for j, b in of.items() if set(a) & set(b)}
    total = {j: sum(v for (_, k), v in w.items() if k == j) for _, j in w}
    frame = sets.all_pairs_jaccard(frame)
    assert {(r.i, r.j): round(r.w, 9) for r in frame.collect()} == {(i, j): round(v / total[j], 9) for (i, j), v in w.items()}
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()


def test_sparse_sets_are_ranked_without_a_count_for_every_set():
    n = 200_000
    table = pa.table({"id": pa.array(np.arange(n)), "members": pa.array([[i // 5] for i in range(n)], pa.list_(pa.int64()))})
    tracemalloc.start()
    asked = sets._nearest_sets(table.slice(100, 200), table, 6)
    first = next(asked)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    rest = list(asked)
    grown = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert first[1].tolist() == [101, 102, 103, 104, 0, 1] and first[3].tolist() == [0, 0, 0, 0, 1, 1]
    assert len(rest) == 199 and grown < 1 << 20


def test_bundles_meet_no_pairs_of_lines(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.uniform(-0.4, 0.4, 300), 2)  # many gaps lie at the reach itself
    table = pa.table({"a": np.arange(300), "b": np.arange(300), "k": np.zeros(300, np.int32), "v": v, "asks": np.ones(300, bool)})
    gap = v[None] - v[:, None]
    got = session._pulled(pa.concat_tables([table, table.set_column(4, "asks", pa.array(np.zeros(300, bool)))]), 0.1)
    assert np.allclose(got.column("gap").to_numpy(), np.where(np.abs(gap) < 0.1, gap, 0).sum(1), atol=1e-12)
    lines = spark.createDataFrame([(i, i, k, float(v[i]), 0.0, 0.0, 0.0) for i in range(30) for k in range(3)], "a long, b long, k int, x double, y double, vx double, vy double")
    assert " oa" not in (plan := session.bundle_step(lines, 3)._jdf.queryExecution().executedPlan().toString()) and "oa#" not in plan


def test_products_and_gaps_give_the_same_repulsion(monkeypatch):
    rng = np.random.default_rng(5)
    y, w, place = rng.normal(size=(700, 2)) * 20 + 90, rng.uniform(0.5, 2, 700), np.arange(700)
    products = embedding.repelled(y, w, y, w, place, place + 1)
    far = embedding.repelled(y * 1e5, w, y * 1e5, w, place, place + 1)
    monkeypatch.setattr(embedding, "MOST_SQUARE", 0)
    for got, want in zip(products, embedding.repelled(y, w, y, w, place, place + 1), strict=True):
        assert np.allclose(got, want, rtol=1e-10, atol=1e-10)
    assert all((a == b).all() for a, b in zip(far, embedding.repelled(y * 1e5, w, y * 1e5, w, place, place + 1), strict=True))


def _drawn(spark, n):
    rng = np.random.default_rng(6)
    start = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(rng.normal(size=(n, 2)))], "id long, y array<double>")
    pairs = spark.createDataFrame([(k, (k * 7 + s) % n, float(rng.uniform())) for k in range(n) for s in (1, 2, 3)], "i long, j long, w double")
    return start, pairs, spark.createDataFrame([(k, 1.0 + k % 3) for k in range(n)], "id long, weight double")


def test_pairs_of_a_step_are_summed_by_tasks(spark, monkeypatch):
    start, pairs, weights = _drawn(spark, 130)
    for mass in (None, weights):
        want = {r.id: r.y for r in embedding.embed(start, pairs, embedding.Parameters(), 4, mass).collect()}
        with monkeypatch.context() as m:
            m.setattr(embedding, "FEW_POINTS", 100)
            m.setattr(embedding, "ROWS_OF_TASK", 50)
            m.setattr(embedding, "_repulsion", None)  # nothing is summed on the driver
            got = {r.id: r.y for r in embedding.embed(start, pairs, embedding.Parameters(), 4, mass).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_weighted_runs_find_neighbours_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(embedding, "embed", lambda start, edges, p, n, weights: asked.extend((edges, weights)) or start)
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(rng.normal(size=(60, 3)))], "id long, features array<double>")
    embedding.weighted_tsne(points, embedding.GraphParameters(perplexity=5))
    assert not any("MapInArrow" in df._jdf.queryExecution().executedPlan().toString() for df in asked)
    sums = {r.id: r.weight for r in asked[1].collect()}
    assert len(sums) == 60 and abs(sum(sums.values()) - 60) < 1e-9


def test_all_pairs_are_neighbours_without_being_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4)) + 30
    x[40:60] = x[0]  # many copies
    points = spark.createDataFrame([(int(k) * 3, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>").repartition(3)
    graph = similarity.symmetrised(similarity.calibrated(knn.knn(points, 89, metric="l2"), 5.0).select("i", "j", "w"))
    want = {r.id: r.y for r in embedding.embed(embedding.initial(points, embedding.EXACT), graph, embedding.EXACT, 8).collect()}
    monkeypatch.setattr(embedding, "_local", None)  # no edges reach the driver
    monkeypatch.setattr(embedding, "ROWS_OF_PAIRS", 40)
    got = {r.id: r.y for r in embedding.exact_tsne(points, 5.0, iterations=8).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-7) for k in want)


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(k, k + 1, 1.0) for k in range(0, 20, 2)] + [(1, 2, 1.0), (30, 31, 0.0)]
    edges = spark.createDataFrame(rows, "i long, j long, w double").mapInArrow(run, "i long, j long, w double")
    got = {r.node: (r.component, r.size) for r in graphs.components(edges, spark.range(32), 0.5).collect()}
    assert got[3] == (0, 4) and got[30] == (30, 1) and got[19] == (18, 2) and len(got) == 32
    assert made.value == len(rows)


def test_walks_over_a_broadcast_graph_equal_those_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = {(int(i), int(j)): float(rng.integers(0, 4)) for i, j in rng.integers(0, 60, (260, 2))}
    edges = spark.createDataFrame([(3 * i, 3 * j, w) for (i, j), w in pairs.items()] + [(0, 999, 1.0)], "i long, j long, w double")
    starts = spark.createDataFrame([(3 * k,) for k in range(60)] + [(7,), (5000,)], "id long")
    stops = spark.createDataFrame([(9,), (30,), (999,), (4,)], "id long")
    rows = lambda df: sorted((r.walk, r.start, -1 if r["at"] is None else r["at"]) for r in df.collect())
    runs = [lambda: graphs.fixed_walks(edges, starts, 5, 4, seed=3), *(lambda o=o: graphs.absorbing_walks(edges, starts, stops, 5, 9, 2, other_than_start=o) for o in (False, True))]
    whole = [run() for run in runs]
    assert all("Join" not in df._jdf.queryExecution().executedPlan().toString() for df in whole)
    got = [rows(df) for df in whole]
    monkeypatch.setattr(graphs, "MOST_EDGES", 0)
    assert got == [rows(run()) for run in runs] and len(got[0]) == 310
    assert graphs.fixed_walks(edges.limit(0), starts.limit(0), 2, 2).count() == 0


def test_probabilities_of_all_points_need_no_shuffle_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = [*rng.normal(size=(40, 5)), *np.repeat(rng.normal(size=(1, 5)), 3, axis=0)]
    points = spark.createDataFrame([(7 * k, [float(v) for v in row]) for k, row in enumerate(x)] + [(999, None)], "id long, features array<double>")
    own = points.selectExpr("id AS i", "id AS j", "0.0D AS d2")
    rows = lambda df: {(r.i, r.j): r.w for r in df.collect()}
    want = rows(similarity.from_distance_matrix(knn.all_distances(points).unionByName(own), 5))
    monkeypatch.setattr(similarity, "ROW_CELLS", 100)
    found = similarity.from_points(points, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = rows(found)
    assert got.keys() == want.keys() and len(got) == 43 * 43 + 1 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert got[999, 999] == got[0, 0] == 0
    twice = rows(similarity.from_points(points.limit(4).unionByName(points.limit(1)), 2))
    assert len(twice) == 16 and similarity.from_points(points.limit(0), 5).count() == 0


def test_all_distances_are_made_without_a_gap_for_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(30, 4)) + 100, np.full((2, 4), 7.0), np.full((1, 4), 7.0 + 1e-6)])
    points = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(99, None)], "id long, features array<double>")
    want = {m: {(r.i, r.j): r.d2 for r in knn.radius(points, points, float("inf"), m).collect()} for m in ("l2sq", "l2", "l1")}
    monkeypatch.setattr(knn, "PAIRS", 70)
    monkeypatch.setattr(knn, "_within", None)
    for m, pairs in want.items():
        got = {(r.i, r.j): r.d2 for r in knn.all_distances(points, m).collect()}
        assert got.keys() == pairs.keys() and len(got) == 33 * 32 and all(np.isclose(got[k], v, rtol=1e-8, atol=1e-9) for k, v in pairs.items())
    assert knn.all_distances(points.limit(0)).count() == 0


def test_walks_between_landmarks_of_graphs_beyond_one_task(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n, marks = 150, [3, 40, 77, 120, 149]
    p = np.zeros((n, n))
    for k in range(n):
        p[k, rng.choice(n, 5, replace=False)] = rng.uniform(size=5) ** 9
    np.fill_diagonal(p, 0)
    p[10, :], p[11, :] = 0, 0
    p[12, :], p[13, :] = 0, 0
    p[12, 13] = p[13, 12] = 1.0  # walks to 10, 11, 12 and 13 meet nothing
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    rest = np.setdiff1d(np.arange(n), [*marks, 12, 13])
    first = p[np.ix_(marks, marks)] + p[np.ix_(marks, rest)] @ np.linalg.solve(np.eye(len(rest)) - p[np.ix_(rest, rest)], p[np.ix_(rest, marks)])
    np.fill_diagonal(first, 0)
    first /= first.sum(1, keepdims=True)
    edges = spark.createDataFrame([(int(i), int(j), float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)], "i long, j long, w double")
    landmarks = spark.createDataFrame([(k,) for k in marks], "id long")
    monkeypatch.setattr(embedding, "ONE_TASK", 100)
    for fill, core in ((0, 7000), (60, 7000), (60, 10), (10**9, 7000)):
        monkeypatch.setattr(embedding, "MOST_FILL", fill, raising=False)
        monkeypatch.setattr(embedding, "MOST_CORE", core, raising=False)
        got = np.zeros((5, 5))
        for r in embedding.meetings(edges, landmarks).collect():
            got[marks.index(r.i), marks.index(r.j)] = r.w
        assert np.allclose(got, first, atol=1e-9)


def test_chances_too_small_for_a_double_are_lost():
    tiny = {0: {5: 1e-320, 6: 1e-320}, 2: {0: 1.0}}
    embedding.shortened(tiny, {2}, 10**9, 9)
    assert tiny == {2: {5: 0.5, 6: 0.5}}
    stuck = {0: {1: 1.0}, 1: {0: 1.0}, 2: {0: 0.5, 7: 0.5}}
    embedding.shortened(stuck, {2}, 10**9, 9)
    assert stuck == {2: {9: 0.5, 7: 0.5}}
