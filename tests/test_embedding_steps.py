import numpy as np
import pytest

from hyperpanel.operators import embedding, tree


def _drawn(spark, y):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(y)], "id long, y array<double>")


def _ring(spark, n):
    return spark.createDataFrame([(k, (k + s) % n, 1.0) for k in range(n) for s in (1, 2)], "i long, j long, w double")


def _sums(df):
    rows = df.orderBy("id").collect()
    return np.array([r.f for r in rows]), np.array([r.z for r in rows])


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_piles_are_near_all_points(spark, dims):
    rng = np.random.default_rng(dims)
    y = np.concatenate([rng.normal(size=(300, dims)) * 4, np.zeros((5, dims))])  # equal points too
    exact, fine, coarse = (_sums(s) for s in (embedding.kernel_sums(_drawn(spark, y)), embedding.piled_sums(_drawn(spark, y), theta=1e-9), embedding.piled_sums(_drawn(spark, y), most=4**dims)))
    assert np.allclose(exact[1], fine[1], rtol=2e-3) and np.abs(exact[0] - fine[0]).max() < 5e-3 * np.abs(exact[0]).max()
    assert abs(coarse[1].sum() - exact[1].sum()) < 0.3 * exact[1].sum()  # few wide piles are rough
    most, w = np.abs(exact[0]).max(), np.ones(len(y))
    for theta in (0.5, 0.25):  # about as far off as the tree over all points
        off = np.abs(_sums(embedding.piled_sums(_drawn(spark, y), theta=theta))[0] - exact[0]).max() / most
        assert off < 1.3 * np.abs(tree.Tree(y, w).repulsion(y, w, theta)[0] - exact[0]).max() / most + 5e-3


def test_piles_weigh(spark):
    rng = np.random.default_rng(5)
    y, w = rng.normal(size=(120, 2)) * 3, rng.uniform(0.5, 2, 120)
    weights = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "id long, weight double")
    exact, piled = (_sums(s) for s in (embedding.kernel_sums(_drawn(spark, y), weights), embedding.piled_sums(_drawn(spark, y), weights, 1e-9)))
    assert np.allclose(exact[1], piled[1], rtol=2e-3) and np.abs(exact[0] - piled[0]).max() < 5e-3 * np.abs(exact[0]).max()


def test_steps_equal_the_run_of_one_task(spark):
    y = np.random.default_rng(7).normal(size=(40, 2)) * 0.1
    p = embedding.Parameters(exaggeration_stop=2, exaggeration_decay=2)
    one, many = (sorted(f(_drawn(spark, y), _ring(spark, 40), p, 4).collect()) for f in (embedding.embed, embedding.embed_by_steps))
    assert np.allclose([r.y for r in one], [r.y for r in many], atol=1e-8)


def test_more_points_than_a_task_go_by_steps(spark, monkeypatch):
    monkeypatch.setattr(embedding, "ONE_TASK", 10)
    y = np.random.default_rng(8).normal(size=(40, 2))
    p = embedding.Parameters(theta=0.5)
    near = np.array([r.y for r in embedding.embed(_drawn(spark, y), _ring(spark, 40), p, 2).orderBy("id").collect()])
    monkeypatch.undo()
    same = np.array([r.y for r in embedding.embed(_drawn(spark, y), _ring(spark, 40), p, 2).orderBy("id").collect()])
    assert np.corrcoef(near.ravel(), same.ravel())[0, 1] > 0.99


def test_no_points(spark):
    none = spark.createDataFrame([], "id long, y array<double>")
    assert embedding.piled_sums(none).count() == 0
    assert embedding.embed_by_steps(none, spark.createDataFrame([], "i long, j long, w double"), embedding.Parameters(), 2).count() == 0
