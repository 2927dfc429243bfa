"""Whole fits on the query data, all features, against plain NumPy versions; trees against
predictions recomputed from the model's own splits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stargauge.operators import models as ops
from stargauge.operators.folded import fold_of
from stargauge.operators.subsets import subset
from stargauge.plans.modelling import model_frames
from stargauge.queries import all_queries


@pytest.fixture(scope="module")
def frames(warehouse):
    """Training and test frames, and the same as arrays, in the order of their keys."""
    train, test = model_frames(warehouse.sets.train, warehouse.sets.test)
    return train, test, arrays(train), arrays(test.withColumn("rev_stars", F.lit(0)))


def arrays(df):
    rows = df.select("review_id", "rev_stars", vector_to_array("features").alias("x")).orderBy("review_id")
    found = rows.collect()
    return [r["review_id"] for r in found], np.array([r["x"] for r in found]), np.array([r["rev_stars"] for r in found], float)


def predicted(name, warehouse):
    return {r["review_id"]: r["prediction"] for r in all_queries()[name].run(warehouse).collect()}


def agree(name, warehouse, frames, weights, intercept, within=6e-5):
    """The query shows four places."""
    keys, x, _ = frames[3]
    found = predicted(name, warehouse)
    assert len(found) == len(keys)
    assert np.abs(np.array([found[key] for key in keys]) - (x @ weights + intercept)).max() <= within


def descent(x, y, l1, l2):
    n = len(y)
    around, target = x - x.mean(0), y - y.mean()
    gram, cross, w = around.T @ around / n, around.T @ target / n, np.zeros(x.shape[1])
    for _ in range(3000):
        for k in range(len(w)):
            gap = cross[k] - gram[k] @ w + gram[k, k] * w[k]
            w[k] = np.sign(gap) * max(abs(gap) - l1, 0) / (gram[k, k] + l2)
    return w, y.mean() - w @ x.mean(0)


def test_ridge(warehouse, frames):
    _, x, y = frames[2]
    agree("m7_ridge", warehouse, frames, *descent(x, y, 0.0, 1.0 / len(y)))


@pytest.mark.parametrize(("name", "ratio"), [("m7_lasso", 1.0), ("m7_elastic_net", 0.5)])
def test_lasso_and_elastic_net(name, ratio, warehouse, frames):
    _, x, y = frames[2]
    agree(name, warehouse, frames, *descent(x, y, 0.01 * ratio, 0.01 * (1 - ratio)))


def test_lasso_with_a_validated_penalty(warehouse, frames):
    keys, x, y = frames[2]
    part = {r["review_id"]: r["f"][0] for r in frames[0].select("review_id", fold_of(F.col("review_id"), 3).alias("f")).collect()}
    fold = np.array([part[key] for key in keys])
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / len(y)
    grid = [top * 1e-3 ** (i / 99) for i in range(100)]
    estimator = ops.lasso_cv()
    estimator.fit(frames[0])
    best = estimator.path.best
    # The whole path would take minutes here: the choice and its neighbours.
    for i in {max(best - 1, 0), best, min(best + 1, 99), 0, 99}:
        errors = []
        for f in range(3):
            w, b = descent(x[fold != f], y[fold != f], grid[i], 0.0)
            errors.append(np.mean((y[fold == f] - x[fold == f] @ w - b) ** 2))
        assert estimator.path.errors[i] == pytest.approx(np.mean(errors), abs=1e-8)
    assert estimator.path.errors[best] == min(estimator.path.errors)
    agree("m8_lasso_cv", warehouse, frames, *descent(x, y, grid[best], 0.0))


def test_gradient_linear(warehouse, frames):
    _, x, y = frames[2]
    agree("m11_gradient_linear", warehouse, frames, *descent(x, y, 0.0, 0.001), within=2e-3)


@pytest.fixture(scope="module")
def subsets(warehouse):
    sources = warehouse.subset_sources
    train, test = model_frames(subset(sources, "all_5_8_train"), subset(sources, "all_1_5_test"))
    return train, test, arrays(train), arrays(test.withColumn("rev_stars", F.lit(0)))


def test_stochastic_gradient(warehouse, subsets):
    """Weights lie within 0.02 of the closed form; so a prediction does within that for every unit
    of its features."""
    _, x, y = subsets[2]
    w, b = descent(x, y, 0.0, 0.001)
    keys, asked, _ = subsets[3]
    found = predicted("m11_stochastic_gradient", warehouse)
    gap = np.abs(np.array([found[key] for key in keys]) - (asked @ w + b))
    assert (gap <= 0.02 * (1 + np.abs(asked).sum(axis=1))).all()


def test_support_vector(warehouse, subsets):
    train, _, (_, x, y), _ = subsets
    estimator = ops.support_vector(0.01, 0.5)
    model = estimator.fit(train)
    assert estimator.gap_left <= 1e-3
    w, b = model.coefficients.toArray(), model.intercept

    def value(w, b):
        return (w @ w + b * b) / 2 + 0.01 * np.maximum(np.abs(y - x @ w - b) - 0.5, 0).sum()

    # Subgradient steps from the fit find nothing better than its gap allows.
    best, w_now, b_now = value(w, b), w.copy(), b
    for step in range(2000):
        lack = y - x @ w_now - b_now
        pull = 0.01 * np.sign(lack) * (np.abs(lack) > 0.5)
        w_now = w_now - 1e-3 / (1 + step / 50) * (w_now - x.T @ pull)
        b_now = b_now - 1e-3 / (1 + step / 50) * (b_now - pull.sum())
        assert value(w_now, b_now) >= best * (1 - 1e-3)


# ---- trees --------------------------------------------------------------------------------


def leaf(node, row):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        below = row[split.featureIndex()] <= split.threshold()
        node = node.leftChild() if below else node.rightChild()
    return node


def recomputed(model, rows, combine):
    trees = [tree._call_java("rootNode") for tree in model.trees]
    return np.array([combine([leaf(root, row) for root in trees]) for row in rows])


@pytest.fixture(scope="module")
def few(frames):
    """Rows whose predictions are recomputed, node by node over the bridge to the engine."""
    test = frames[1].orderBy("review_id").limit(40)
    return test, [r["x"] for r in test.select(vector_to_array("features").alias("x"), "review_id").orderBy("review_id").collect()]


def scores(model, test):
    return np.array([r["prediction"] for r in model.transform(test).orderBy("review_id").collect()])


def test_forest_is_the_mean_of_its_trees(frames, few):
    model = ops.forest(20, 6).fit(frames[0])
    mean = recomputed(model, few[1], lambda leaves: np.mean([n.prediction() for n in leaves]))
    assert np.allclose(scores(model, few[0]), mean)


def test_boosted_trees_are_the_weighted_sum(frames, few):
    model = ops.boosted_trees(20).fit(frames[0])
    weights = np.array(model.treeWeights)
    total = recomputed(model, few[1], lambda leaves: weights @ [n.prediction() for n in leaves])
    assert np.allclose(scores(model, few[0]), total)


def test_forest_classifier_adds_up_the_shares_of_its_leaves(frames, few):
    model = ops.forest_classifier(20, 6).fit(frames[0])

    def votes(leaves):
        stats = np.array([list(n.impurityStats().stats()) for n in leaves])
        return (stats / stats.sum(axis=1, keepdims=True)).sum(axis=0).argmax()

    assert (scores(model, few[0]) == recomputed(model, few[1], votes)).all()


@pytest.mark.parametrize("make", [ops.forest, ops.boosted_trees])
def test_leaves_are_the_means_of_their_rows(make, frames):
    """Grown without resampling, the first tree predicts the mean of the rows in each leaf."""
    estimator = make(1, 3)
    if make is ops.forest:
        estimator = estimator.setBootstrap(False)
    model = estimator.fit(frames[0])
    rows = model.transform(frames[0]).groupBy("prediction").agg(F.avg("rev_stars").alias("mean")).collect()
    assert 1 < len(rows) <= 8
    assert all(abs(row["prediction"] - row["mean"]) < 1e-6 for row in rows)
