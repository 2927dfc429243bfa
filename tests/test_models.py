from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import values
from stargauge.operators import features as feats
from stargauge.operators import models as ops
from stargauge.queries import all_queries

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """300 rows of correlated features with a noisy label; ``c`` does not matter."""
    noise = np.random.default_rng(7)
    x = noise.normal(size=(300, 3))
    x[:, 1] += 0.5 * x[:, 0]
    y = 3 + 1.5 * x[:, 0] - 0.7 * x[:, 1] + 0.1 * noise.normal(size=300)
    data = [(str(i), float(y[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(
        data, "review_id string, rev_stars double, a double, b double, c double"
    )
    return feats.assemble(df, NAMES).persist(), x, y


def centred(rows):
    _, x, y = rows
    return x - x.mean(0), y - y.mean()


def descent(x, y, l1, l2):
    """Coordinate descent on ``|y - Xw|^2 / 2n + l1 |w| + l2 |w|^2 / 2``."""
    n = len(y)
    gram, target, w = x.T @ x / n, x.T @ y / n, np.zeros(x.shape[1])
    for _ in range(1000):
        for k in range(len(w)):
            gap = target[k] - gram[k] @ w + gram[k, k] * w[k]
            w[k] = np.sign(gap) * max(abs(gap) - l1, 0) / (gram[k, k] + l2)
    return w


def test_least_squares_on_an_exact_line(spark):
    data = [(str(i), 2.0 + 3.0 * i - j, float(i), float(j)) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(data, "review_id string, rev_stars double, a double, b double")
    model = ops.least_squares().fit(feats.assemble(df, ["a", "b"]))
    assert np.allclose(model.coefficients.toArray(), [3, -1], atol=1e-9)
    assert abs(model.intercept - 2) < 1e-8


def test_ridge_matches_its_closed_form(rows):
    x, y = centred(rows)
    for alpha in (1.0, 200.0):
        model = ops.ridge(rows[0], alpha).fit(rows[0])
        exact = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ y)
        assert np.allclose(model.coefficients.toArray(), exact, atol=1e-8)


def test_penalised_fits_match_coordinate_descent(rows):
    x, y = centred(rows)
    model = ops.lasso(0.1).fit(rows[0])
    assert np.allclose(model.coefficients.toArray(), descent(x, y, 0.1, 0), atol=1e-6)
    model = ops.elastic_net(rows[0], 0.4, 0.3).fit(rows[0])
    assert np.allclose(model.coefficients.toArray(), descent(x, y, 0.12, 0.28), atol=1e-5)


def test_gradient_linear_is_near_its_optimum(rows):
    x, y = centred(rows)
    model = ops.gradient_linear(rows[0], 0.01).fit(rows[0])
    assert np.allclose(model.coefficients.toArray(), descent(x, y, 0, 0.01), atol=1e-3)


def test_largest_penalty_empties_the_lasso(rows):
    top = ops.largest_penalty(rows[0])
    assert not ops.lasso(top * 1.001).fit(rows[0]).coefficients.toArray().any()
    assert ops.lasso(top * 0.99).fit(rows[0]).coefficients.toArray().any()


def test_lasso_cv_picks_a_small_penalty_for_a_clear_signal(rows):
    estimator = ops.lasso_cv(folds=3, penalties=4)
    estimator.fit(rows[0])
    chosen = estimator.path.penalties[estimator.path.best]
    assert chosen < ops.largest_penalty(rows[0]) / 50


def test_prediction_column_and_tree_models(rows):
    for estimator in (ops.forest(5, 4), ops.boosted_trees(5)):
        scored, _ = ops.fit_predict(rows[0], rows[0], estimator, "X")
        assert scored.columns == [*rows[0].columns, "predictions_X"]
        error = scored.select(ops.rmse(F.col("rev_stars"), F.col("predictions_X"))).first()[0]
        assert error < np.std(rows[2])
    classes = rows[0].withColumn("rev_stars", (F.col("a") > 0).cast("double"))
    scored, _ = ops.fit_predict(classes, classes, ops.forest_classifier(5, 4), "X")
    right = scored.where(F.col("predictions_X") == F.col("rev_stars")).count()
    assert right > 290
    assert scored.columns == [*classes.columns, "predictions_X"]


def test_cross_validation_matches_a_manual_holdout(rows):
    df, x, y = rows
    got = {r["fold"]: (r["n"], r["rmse"]) for r in
           ops.cross_validate(df, ops.least_squares(), 2, 0.3).collect()}
    held = ops.with_folds(df.select("review_id"), 2, 0.3)
    for fold in (0, 1):
        out = [int(r[0]) for r in held.where(F.col("fold") == fold).select("review_id").collect()]
        keep = np.setdiff1d(np.arange(300), out)
        w, *_ = np.linalg.lstsq(np.c_[np.ones(len(keep)), x[keep]], y[keep], rcond=None)
        rmse = np.sqrt(np.mean((y[out] - np.c_[np.ones(len(out)), x[out]] @ w) ** 2))
        assert got[fold][0] == len(out)
        assert abs(got[fold][1] - rmse) < 1e-9


def test_forward_selection_takes_the_signal_first(rows):
    steps = [
        (r["feature"], r["mean_rmse"])
        for r in ops.forward_selection(rows[0].drop("features"), NAMES, folds=2).collect()
    ]
    assert steps[0][0] == "a" and steps[1][0] == "b"
    assert all(later[1] < earlier[1] for earlier, later in zip(steps, steps[1:], strict=False))


def test_standardized_training_columns(rows):
    (scaled,) = feats.standardize(rows[0], [rows[0]], ["a", "b"])
    stats = feats.moments(scaled, ["a_scaled", "b_scaled"]).first()
    assert np.allclose(list(stats), [0, 0, 1, 1], atol=1e-12)


def test_constant_feature_is_only_centred(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "k double")
    (scaled,) = feats.standardize(df, [df], ["k"])
    assert values(scaled, "k_scaled") == [(0.0,), (0.0,)]


def test_unseen_labels_have_no_slot(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "zip string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "zip string")
    for output in feats.one_hot(train, [test], "zip"):
        got = output.select("zip", vector_to_array("zip_vector").alias("v"))
        assert values(got) == [("a", [1.0, 0.0]), ("z", [0.0, 0.0]), (None, [0.0, 0.0])]



def test_multi_hot_is_binary_and_bounded(spark):
    df = spark.createDataFrame(
        [("1", ["a", "a", "b"]), ("2", []), ("3", ["c"])],
        "review_id string, bus_categories array<string>",
    )
    vectors, vocabulary = feats.multi_hot(df, df, k=2)
    assert vocabulary == ["a", "b"]
    got = vectors.select("review_id", vector_to_array("category_vector").alias("v"))
    assert values(got) == [("1", [1.0, 1.0]), ("2", [0.0, 0.0]), ("3", [0.0, 0.0])]
    assert values(feats.multi_hot_long(df, df, k=2)) == [("1", "a"), ("1", "b")]


@pytest.mark.parametrize(
    "name", sorted(name for name, found in all_queries().items() if found.sql is None)
)
def test_fit_queries_run(name, warehouse):
    df = all_queries()[name].run(warehouse)
    assert df.count() > 0
    assert all(value is not None for value in df.first())
