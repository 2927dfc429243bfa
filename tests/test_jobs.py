"""Whole runs from files, compared with the same work on the tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import values
from stargauge import schemas
from stargauge.plans import jobs
from stargauge.operators.subsets import subset
from stargauge.plans.dimensions import read_dimensions, write_dimensions
from stargauge.plans.modelling import score
from stargauge.queries import all_queries
from stargauge.sources import readers, writers


@pytest.fixture(scope="module")
def folder(spark, warehouse, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("files"))
    for name in ("train", "test", "old_test"):
        split = getattr(warehouse, f"raw_{name}")
        for entity in schemas.ENTITIES:
            getattr(split, entity).write.json(f"{base}/{name}_{entity}.json")
    columns = ["user_id", "business_id", "RecommendationId"]
    writers.write_csv(warehouse.id_lookup, f"{base}/{readers.FILES['lookup']}", columns)
    return base


@pytest.fixture(scope="module")
def workspace(spark, folder):
    return jobs.open_workspace(spark, folder)


def test_predictions_from_files(spark, warehouse, workspace, tmp_path):
    path = jobs.predict_subset(
        workspace, "all_5_8_train", "all_1_5_test", str(tmp_path), submission="9"
    )
    written = spark.read.schema("review_id string, stars double").option("header", True).csv(path)
    expected = values(all_queries()["m16_subset_to_subset"].run(warehouse))
    got = [(key, round(stars, 4)) for key, stars in values(written)]
    assert [key for key, _ in got] == [key for key, _ in expected]
    assert all(abs(a - b) < 2e-4 for (_, a), (_, b) in zip(got, expected, strict=True))


def test_benchmarks_from_files(spark, workspace, tmp_path):
    paths = jobs.submit_benchmarks(workspace, str(tmp_path), submission="9")
    assert len(paths) == 3
    reviews = workspace.test.review.count()
    for path in paths:
        read = spark.read.option("header", True).csv(path)
        assert read.columns == ["RecommendationId", "stars"]
        assert read.count() == reviews
        assert read.where("stars IS NULL").count() == 0


def test_written_dimensions_replace_computed_ones(spark, folder, workspace, tmp_path):
    write_dimensions(workspace.dimensions, workspace.everything, str(tmp_path))
    known = read_dimensions(spark, str(tmp_path))
    again = jobs.open_workspace(spark, folder, dimensions=known)
    columns = ["review_id", "calc_cat_avg", "bus_name_counts", "grp_cat_counts"]
    assert values(again.sets.master, *columns) == values(workspace.sets.master, *columns)


def test_whole_submission_has_every_review_once(spark, workspace, tmp_path):
    rules = [
        jobs.Rule("all_5_8_train", "all_1_5_test"),
        jobs.Rule("names_1_train", "names_1_test", ["bus_review_count", "bus_name_avg"]),
    ]
    path = jobs.submit_all(workspace, rules, str(tmp_path), submission="9")
    read = spark.read.schema("review_id string, stars double").option("header", True).csv(path)
    reviews = workspace.test.review
    assert read.where("stars IS NULL").count() == 0
    assert read.count() == read.select("review_id").distinct().count() == reviews.count()


def test_numbers_with_zip_and_category_vectors(workspace):
    from stargauge.operators import features as ops
    from stargauge.operators import models
    from stargauge.plans.modelling import train_and_score

    train, test = workspace.sets.train, workspace.sets.test
    (train, test) = ops.one_hot(train, [train, test], "bus_zip_code")
    (train, _), (test, _) = (ops.multi_hot(df, workspace.sets.train) for df in (train, test))
    extra = ["bus_open", "bus_zip_code_vector", "category_vector"]
    scored, model = train_and_score(
        train, test, models.ridge(train, 10.0), "Ridge", extra=extra
    )
    assert scored.count() == test.count()
    assert scored.where("predictions_Ridge IS NULL").count() == 0
    assert model.stages[-1].numFeatures > len(ops.QUANT_FEATURES) + 1


def test_validation_and_a_saved_model(spark, workspace, tmp_path):
    scores = jobs.validate_subset(workspace, "all_5_8_train", folds=3).collect()
    assert [row["fold"] for row in scores] == [0, 1, 2] and all(row["rmse"] > 0 for row in scores)
    jobs.predict_subset(
        workspace, "all_5_8_train", "all_1_5_test", str(tmp_path / "out"), submission="9",
        model_folder=str(tmp_path / "models"),
    )
    assert len(list((tmp_path / "models").iterdir())) == 1


def test_saved_model_scores_raw_rows(spark, workspace, tmp_path):
    """What a job saved predicts what the job predicted, without anything else of the run."""
    path = jobs.predict_subset(
        workspace, "all_5_8_train", "all_1_5_test", str(tmp_path), submission="9",
        extra=["bus_open"], categorical=["bus_zip_code"], categories=True,
        model_folder=str(tmp_path / "models"),
    )
    written = spark.read.schema("review_id string, stars double").option("header", True).csv(path)
    scored = jobs.score_saved(workspace, str(tmp_path / "models"), "all_1_5_test")
    expected, got = values(written), values(scored, "review_id", "predictions_LinReg")
    assert [key for key, _ in got] == [key for key, _ in expected]
    for (_, a), (_, b) in zip(got, expected, strict=True):
        assert a == b or abs(a - b) < 1e-9
    # A row without a value has no prediction, one of an unseen zip code has one.
    rows = scored.drop("predictions_LinReg").limit(1)
    model = writers.load_model(writers.saved_models(spark, str(tmp_path / "models"), "LinReg")[-1])
    odd = rows.withColumn("bus_zip_code", F.lit("unseen")).withColumn("bus_categories", F.lit(None).cast("array<string>"))
    assert score(model, odd, "X").first()["predictions_X"] is not None
    missing = rows.withColumn("bus_stars", F.lit(None).cast("double"))
    assert score(model, missing, "X").first()["predictions_X"] is None


def test_the_last_model_of_a_name_is_loaded(spark, workspace, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.score_saved(workspace, str(tmp_path), "all_1_5_test")
    for features in (["bus_stars"], ["user_average_stars"]):
        jobs.predict_subset(
            workspace, "all_5_8_train", "all_1_5_test", str(tmp_path / "out"), submission="1",
            features=features, model_folder=str(tmp_path / "models"),
        )
    paths = writers.saved_models(spark, str(tmp_path / "models"), "LinReg")
    assert len(paths) == 2
    last = writers.load_model(paths[-1])
    assert last.stages[1].getInputCols() == ["user_average_stars_scaled"]


def test_zip_and_category_vectors_in_a_job(workspace):
    """Least squares on the sparse vectors against a dense solution of the same columns."""
    train = subset(workspace.subsets, "all_5_8_train")
    scored, model = jobs.fit_subset(
        workspace, "all_5_8_train", "all_5_8_train", categorical=["bus_zip_code"], categories=True
    )
    columns = model.stages[-2].getInputCols()
    assert columns[-2:] == ["bus_zip_code_vector", "category_vector"]
    rows = model.transform(train).select(vector_to_array("features").alias("x"), "rev_stars", "prediction").collect()
    x = np.column_stack([np.ones(len(rows)), np.array([row["x"] for row in rows])])
    y = np.array([row["rev_stars"] for row in rows], float)
    exact = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(exact - [row["prediction"] for row in rows]).max() < 1e-4
    assert scored.count() == len(rows)


def test_first_rule_with_a_prediction_wins_in_one_pass(spark, warehouse, monkeypatch):
    reviews = [row[0] for row in warehouse.test.review.select("review_id").limit(3).collect()]
    made = {
        "a": [(reviews[0], 2.5), (reviews[0], 2.0), (reviews[1], None)],
        "b": [(reviews[0], 1.0), (reviews[1], 4.5), (None, 3.0)],
    }
    frames = {
        name: spark.createDataFrame(rows, "review_id string, predictions_rule double")
        for name, rows in made.items()
    }
    staged = []
    monkeypatch.setattr(jobs, "fit_subset", lambda work, train, *more: (frames[train], None))
    monkeypatch.setattr(jobs, "stage", lambda df, label: staged.append(label) or df)
    work = jobs.Workspace(
        warehouse.train, warehouse.test, warehouse.everything, None, None, None, None
    )
    found = jobs.predict_all(work, [jobs.Rule("a", "t"), jobs.Rule("b", "t")])
    stars = {row["review_id"]: row["stars"] for row in found.collect()}
    assert stars[reviews[0]] == 2.0 and stars[reviews[1]] == 4.5
    assert None not in stars and len(stars) == warehouse.test.review.count()
    assert "ranked-predictions" not in staged
