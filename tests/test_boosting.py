"""Boosted trees on binned rows against Spark ML's own fit, and what a pass brings to Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from stargauge.operators import boosting
from stargauge.operators import models as ops


def frame(spark, rows, parts=3):
    """A feature of many values, one of few, one mostly zero and one constant."""
    n = spark.range(0, rows, 1, parts)
    x = F.array(F.rand(1), F.col("id") % 7 / 2.0, F.greatest(F.rand(2) - 0.8, F.lit(0.0)), F.lit(3.0))
    label = F.round(x[0] * 3 + (x[1] > 1).cast("int") + 4 * x[2] + F.rand(3), 0)
    return n.select("id", array_to_vector(x).alias("features"), label.alias("rev_stars"))


def split_lines(model):
    return [
        [line for line in tree.toDebugString.splitlines()[1:] if "Predict" not in line]
        for tree in model.trees
    ]


@pytest.mark.parametrize("rows", [400, 14_000])
def test_trees_are_those_of_spark_ml(spark, tmp_path, rows):
    """With so many rows that cuts come from a sample, too, and with rows written anew."""
    path = str(tmp_path / "rows")
    frame(spark, rows).write.parquet(path)
    df = spark.read.parquet(path)
    settings = {"maxIter": 13, "maxDepth": 3, "stepSize": 0.1, "seed": 0, **ops.COLUMNS}
    made = ops.boosted_trees(13).fit(df)
    plain = GBTRegressor(**settings).fit(df)
    assert split_lines(made) == split_lines(plain)
    assert list(made.treeWeights) == list(plain.treeWeights)
    both = (model.transform(df).orderBy("id").toPandas().prediction for model in (made, plain))
    assert np.allclose(*both, rtol=0, atol=1e-9)


def test_rows_are_read_once_a_level_as_small_codes(spark, monkeypatch):
    """A pass reads one byte a feature, the label and what is fitted so far; no pass is without use."""
    passes = []
    sums = boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda cells, *rest, **more: passes.append(cells) or sums(cells, *rest, **more))
    ops.boosted_trees(4, 2).fit(frame(spark, 900))
    assert len(passes) == 8
    sizes = passes[0].selectExpr(*(f"sum(length({c}))" for c in passes[0].columns)).first()
    assert tuple(sizes) == (4 * 900, 8 * 900, 8 * 900)


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = frame(spark, 300)
    model = ops.boosted_trees(3, 2).fit(df)
    path = str(tmp_path / "model")
    model.save(path)
    again = GBTRegressionModel.load(path)
    both = (m.transform(df).orderBy("id").toPandas().prediction for m in (model, again))
    assert np.array_equal(*both)


@pytest.mark.parametrize("label", ["1.5D", "cast(id % 2 AS double)"])
def test_constant_labels_and_constant_features(spark, label):
    df = spark.range(20).select(
        "id", array_to_vector(F.array(F.lit(1.0), F.lit(0.0))).alias("features"), F.expr(label).alias("rev_stars")
    )
    made = ops.boosted_trees(3).fit(df).transform(df)
    plain = GBTRegressor(maxIter=3, maxDepth=3, seed=0, **ops.COLUMNS).fit(df).transform(df)
    assert sorted(r["prediction"] for r in made.collect()) == sorted(r["prediction"] for r in plain.collect())


def test_missing_labels_are_refused(spark):
    df = frame(spark, 50).withColumn("rev_stars", F.when(F.col("id") > 3, F.col("rev_stars")))
    with pytest.raises(Exception, match="finite label"):
        ops.boosted_trees(2).fit(df)


def test_settings_beyond_the_passes_go_to_spark_ml(spark):
    df = frame(spark, 400)
    made = ops.boosted_trees(3).setSubsamplingRate(0.5).fit(df)
    plain = GBTRegressor(maxIter=3, maxDepth=3, seed=0, subsamplingRate=0.5, **ops.COLUMNS).fit(df)
    assert split_lines(made) == split_lines(plain)
