"""Fits that do not read the key of their rows do not stage it either."""

from __future__ import annotations

import pytest

from conftest import values
from stargauge.operators import models as ops
from stargauge.operators.features import QUANT_FEATURES
from stargauge.plans import modelling


@pytest.fixture(scope="module")
def rows(spark):
    """Repeated rows and keys, and one null key."""
    numbers = [(f"r{i // 2}" if i % 9 else None, 1 + i % 5, *((i * k) % 7 / 2 for k in range(1, 7)), i % 2 == 0) for i in range(60)]
    schema = "review_id string, rev_stars bigint, " + ", ".join(f"{n} double" for n in QUANT_FEATURES)
    return spark.createDataFrame(numbers + numbers[:5], schema + ", bus_open boolean")


@pytest.fixture
def staged(monkeypatch):
    found, stage = {}, modelling.stage

    def kept(df, label):
        found[label] = df.columns
        return stage(df, label)

    monkeypatch.setattr(modelling, "stage", kept)
    return found


@pytest.mark.parametrize("make", [ops.least_squares, lambda: ops.extra_trees(3, 3)])
def test_a_fit_stages_no_key_it_does_not_read(rows, staged, make):
    scored, _ = modelling.train_and_score(rows, rows, make(), "X", extra=["bus_open"])
    assert staged["training-rows"] == ["rev_stars", *QUANT_FEATURES, "bus_open"]
    train, test = modelling.model_frames(rows, rows, extra=["bus_open"])
    expected, _ = ops.fit_predict(train, test, make(), "X")
    rounded = "review_id", "round(predictions_X, 6) AS x"
    assert values(scored.selectExpr(*rounded)) == values(expected.selectExpr(*rounded))


def test_folds_and_shards_keep_the_key(rows, staged):
    for estimator in (ops.lasso_cv(), ops.stochastic_gradient(epochs=2)):
        modelling.scoring_model(rows, estimator)
        assert staged["training-rows"][0] == "review_id"


def test_frames_without_a_key_have_the_same_rows(rows, staged):
    keyed, _ = modelling.model_frames(rows, rows)
    assert staged["training-rows"][0] == "review_id"
    plain, test = modelling.model_frames(rows, rows, keyed=False)
    assert staged["training-rows"] == ["rev_stars", *QUANT_FEATURES]
    assert values(plain) == values(keyed.drop("review_id"))
    assert "review_id" in test.columns
