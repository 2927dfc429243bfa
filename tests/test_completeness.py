"""No row may vanish: NULL features, NULL lists, unknown flags, staged tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from stargauge.operators import features as ops
from stargauge.operators import models
from stargauge.sources import scratch
from stargauge.sources.staging import stage


def vectors(df, column):
    found = [row[column] for row in df.orderBy("k").collect()]
    return [None if vector is None else vector.toArray().tolist() for vector in found]


def test_multi_hot_of_a_null_list(spark):
    rows = [(1, ["a", "b"]), (2, None), (3, []), (4, ["b", "b"])]
    df = spark.createDataFrame(rows, "k int, bus_categories array<string>")
    encoded, vocabulary = ops.multi_hot(df, df)
    assert vocabulary == ["b", "a"] and encoded.columns == [*df.columns, "category_vector"]
    assert vectors(encoded, "category_vector") == [[1, 1], [0, 0], [0, 0], [1, 0]]


def test_an_unknown_flag_stays_unknown(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False)], "k int, open boolean")
    (encoded,) = ops.one_hot(df, [df], "open")
    assert vectors(encoded, "open_vector") == [[1.0], None, [0.0]]


def test_incomplete_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 4.0, None)], "k int, a double, b double")
    assert vectors(ops.assemble(df, ["a", "b"], incomplete="null"), "features") == [[1, 2], None, None]
    with pytest.raises(Exception, match="without a value in a"):
        ops.assemble(df.where("k < 3"), ["a", "b"]).collect()


def test_every_test_row_is_predicted_or_null(spark):
    train = spark.range(20).selectExpr("id AS review_id", "id * 2.0D + 1 AS rev_stars", "id * 1.0D AS x")
    test = spark.createDataFrame([(1, 3.0), (2, None)], "review_id long, x double")
    fitted = ops.assemble(train, ["x"])
    scored, _ = models.fit_predict(
        fitted, ops.assemble(test, ["x"], incomplete="null"), models.least_squares(), "L"
    )
    got = {r["review_id"]: r["predictions_L"] for r in scored.collect()}
    assert got[1] == pytest.approx(7.0) and got[2] is None


def test_one_hot_of_very_many_labels(spark):
    n = 120_000
    train = spark.range(n, numPartitions=7).select(F.format_string("%06d", "id").alias("word"))
    df = spark.createDataFrame([(1, "000000"), (2, "119999"), (3, "none"), (4, None)], "k int, word string")
    (encoded,) = ops.one_hot(train, [df], "word")
    rows = [r["word_vector"] for r in encoded.orderBy("k").collect()]
    assert [v.size for v in rows] == [n] * 4
    assert [v.indices.tolist() for v in rows] == [[0], [n - 1], [], []]


def test_gradient_model_on_few_rows(spark):
    rows = [(i, float(y), [float(x)]) for i, (x, y) in enumerate([(-2, 1), (-1, 3), (0, 2), (1, 4), (2, 5)])]
    df = spark.createDataFrame(rows, "review_id long, rev_stars double, v array<double>")
    from pyspark.ml.functions import array_to_vector

    train = df.select("review_id", "rev_stars", array_to_vector("v").alias("features"))
    model = models.gradient_linear(train, 0.5).fit(train)
    # g / (variance + alpha)
    assert model.coefficients[0] == pytest.approx(1.8 / (2 + 0.5), abs=1e-4)


class _Elsewhere:
    class sparkContext:
        master, applicationId = "spark://host:7077", "app"

    class conf:
        @staticmethod
        def get(_, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(_Elsewhere)


def test_a_closed_run_leaves_no_table(spark, tmp_path, monkeypatch):
    # A folder of its own: other tests still read theirs.
    folder = f"{tmp_path}/run"
    monkeypatch.setattr(scratch, "run_dir", lambda _: folder)
    stage(spark.range(5), "some")
    assert os.path.isdir(folder)
    scratch.close_run(spark)
    assert not os.path.exists(folder)
