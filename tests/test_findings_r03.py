"""What the findings of the third round asked for, each at a size that shows it."""

import numpy as np
import pytest

from hyperpanel.operators import embedding, hsne, knn, session


def _cloud(spark, n):
    rng = np.random.default_rng(1)
    y = spark.createDataFrame([(3 * k, [float(v) for v in row]) for k, row in enumerate(rng.normal(size=(n, 2)) * 4)], "id long, y array<double>").repartition(3)
    edges = spark.createDataFrame([(3 * k, 3 * ((k * 7 + s) % n), float(rng.uniform())) for k in range(n) for s in (1, 2, 3)] + [(0, 1, 5.0), (1, 0, 5.0)], "i long, j long, w double")
    return y, edges, spark.createDataFrame([(3 * k, 1.0 + k % 3) for k in range(n)], "id long, weight double")


@pytest.mark.parametrize("p", [embedding.Parameters(), embedding.Parameters(theta=0.5), embedding.Parameters(repulsion="field"), embedding.Parameters(repulsion="raster")])
def test_runs_sum_the_same_forces_whatever_the_number_of_points(spark, monkeypatch, p):
    y, edges, weights = _cloud(spark, 150)
    for mass in (None, weights):
        want = {r.id: r.y for r in embedding.embed(y, edges, p, 5, mass).collect()}
        with monkeypatch.context() as m:
            m.setattr(embedding, "ONE_TASK", 10)
            m.setattr(embedding, "MOST_CELLS", 20)
            m.setattr(embedding, "ROWS_OF_TASK", 256 // 2)
            m.setattr(embedding, "ROWS_OF_PIXELS", 4, raising=False)
            got = {r.id: r.y for r in embedding.embed(y, edges, p, 5, mass).collect()}
        assert len(got) == 150 and got == want


def test_all_pairs_are_summed_in_one_way_beyond_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4)) + 30
    points = spark.createDataFrame([(5 * k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>").repartition(3)
    want = {r.id: r.y for r in embedding.exact_tsne(points, 5.0, iterations=6).collect()}
    monkeypatch.setattr(knn, "MOST_CELLS", 100)
    monkeypatch.setattr(embedding, "MOST_CELLS", 100)
    monkeypatch.setattr(embedding, "BLOCK_CELLS", 200, raising=False)
    monkeypatch.setattr(embedding, "ROWS_OF_PAIRS", 50)
    monkeypatch.setattr(embedding, "ONE_TASK", 10)
    monkeypatch.setattr(knn, "knn", None)  # pairs are never edges
    monkeypatch.setattr(embedding, "_local", None)
    got = {r.id: r.y for r in embedding.exact_tsne(points, 5.0, iterations=6).collect()}
    assert len(got) == 150 and got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-5, atol=1e-9) for k in want)
    assert embedding.exact_tsne(points.limit(0), 5.0, iterations=2).count() == 0


def test_weighted_runs_are_the_same_whatever_the_number_of_points(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(60, 3))
    points = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, features array<double>")
    run = lambda: {r.id: r.y for r in embedding.weighted_tsne(points, embedding.GraphParameters(perplexity=5), embedding.Parameters(theta=0.5, decay="exponential"), 4).collect()}
    want = run()
    monkeypatch.setattr(embedding, "ONE_TASK", 10)
    got = run()
    assert len(got) == 60 and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    y, edges, weights = _cloud(spark, 40)
    few = embedding.embed(y, edges, embedding.Parameters(), 2, weights.filter("id > 0")).collect()  # a point without a weight neither pushes nor is lost
    assert len(few) == 40


@pytest.mark.parametrize("metric", ["l1", "l2", "l2sq"])
def test_neighbours_are_found_without_points_on_the_driver(spark, monkeypatch, metric):
    x = np.random.default_rng(4).integers(0, 4, (90, 3)) + 0.5  # many ties and copies
    points = spark.createDataFrame([(7 * k, [float(v) for v in row]) for k, row in enumerate(x)] + [(0, [0.5, 0.5, 0.5])], "id long, features array<double>").repartition(3)
    want = sorted(knn.knn(points, 12, metric, method="broadcast").collect())
    monkeypatch.setattr(knn, "fetched", None)  # nothing is fetched
    for cells in (knn.BLOCK_CELLS, 50, 1):
        monkeypatch.setattr(knn, "BLOCK_CELLS", cells)
        assert sorted(knn.knn(points, 12, metric).collect()) == want
    assert knn.knn(points.limit(0), 3).count() == 0 and knn.knn(points.limit(1), 3).count() == 0


def test_links_and_influences_broadcast_no_table_that_grows(spark):
    rows = lambda names: spark.createDataFrame([(1, 2), (2, 2)], names)
    links = session.connections(rows("id long, lm long"), rows("a long, b long"), rows("id long, lm long"))
    assert [tuple(r) for r in links.collect()] == [(2, 2, 2)]
    points = spark.createDataFrame([(1, 1.0), (2, 1.0)], "lm long, weight double")
    aoi = spark.createDataFrame([(1, 2, 0.5), (2, 2, 1.0)], "prev long, lm long, p double")
    weights = hsne.interpolation_weights(hsne.Hierarchy([hsne.Scale(points, aoi), hsne.Scale(points, aoi, aoi)]))
    assert sorted(map(tuple, weights.collect())) == [(1, 2, 0.5), (2, 2, 1.0)]
    for df in (links, weights):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
