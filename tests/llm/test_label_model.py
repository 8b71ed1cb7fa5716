"""The label model recovers a known model from votes alone; the classifier's fit; disagreeing labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperpanel.llm import common, toxicity

M, N, BALANCE = 12, 40_000, 0.15
PAIRS = [(0, 1), (6, 7)]


@pytest.fixture(scope="module")
def drawn(spark):
    g = np.random.default_rng(5)
    y = g.random(N) < BALANCE
    high, low = g.uniform(0.2, 0.6, M), g.uniform(0.005, 0.06, M)
    votes = g.random((N, M)) < np.where(y[:, None], high, low)
    for a, b in PAIRS:  # the second repeats the first in two thirds of the texts
        votes[:, b] = np.where(g.random(N) < 0.67, votes[:, a], votes[:, b])
    high, low = votes[y].mean(0), votes[~y].mean(0)
    bits, n = np.unique(np.packbits(votes, axis=1), axis=0, return_counts=True)
    patterns = spark.createDataFrame([(bytearray(b.tobytes()), int(k)) for b, k in zip(bits, n, strict=True)], "pattern binary, n long").repartition(3).cache()
    return votes, y, high, low, patterns


def test_rates_and_correlations_without_labels(drawn):
    votes, y, high, low, patterns = drawn
    model = toxicity.fit_label_model(patterns, np.arange(M), np.ones(M, bool), BALANCE, votes.mean(0))
    assert np.abs(model.on_toxic - high).max() < 0.05 and np.abs(model.on_clean - low).max() < 0.05
    found = {(int(a), int(b)) for a, b in np.argwhere(np.triu(model.shared) > 0)}
    assert found == set(PAIRS)
    assert ((model.posterior(votes.astype(float)) > 0.5) == y).mean() > 0.93


def test_moments_count_pairs(drawn):
    votes, _, _, _, patterns = drawn
    both, rows = toxicity.moments(patterns, M)
    assert rows == N and (both == votes.astype(int).T @ votes.astype(int)).all()


def test_logistic_finds_the_optimum(spark):
    g = np.random.default_rng(2)
    x = g.random((600, 9)) < 0.3
    y = 1 / (1 + np.exp(-(x @ g.normal(size=9) - 0.5)))
    rows = spark.createDataFrame([(bytearray(np.packbits(r).tobytes()), float(t)) for r, t in zip(x, y, strict=True)], "features binary, posterior double").repartition(2).cache()
    w = toxicity.logistic(rows, 9, ridge=0.1)
    q = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(np.append(x.T @ (q - y) + 0.1 * w[:-1], (q - y).sum())).max() < 0.05


def test_disagreeing_labels(spark, docs):
    """A majority decides, a tie leaves the id out, however the rows lie."""
    rows = [(k, k % 2) for k in range(40)] + [(k, 1 - k % 2) for k in range(40)] + [(1, 1), (2, 0)] + [(3, 0)]
    for parts in (1, 3):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int").repartition(parts)
        training = docs.filter("doc_id IN (1, 2, 3)").select("doc_id").count()
        assert training == 3
        classifier = toxicity.train(docs, labels)
        assert abs(classifier.label_model.balance - 1 / 3) < 1e-9


def test_held_out_quality_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    labels = common.read_table(spark, folder, "labels")
    row = toxicity.query(spark, folder).join(labels, "doc_id").filter("held_out").agg(
        (F.sum(F.col("predicted") * F.col("toxic")) / F.sum("toxic")).alias("recall"), (F.sum(F.col("predicted") * F.col("toxic")) / F.sum("predicted")).alias("precision")).first()
    assert row.recall >= 0.845 and row.precision > 0.95
