"""Whole runs from entity files to submission files."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.operators import benchmarks
from stargauge.operators.cleaning import clean_splits
from stargauge.operators.dimensions import category_vocabulary
from stargauge.operators.joins import (
    attach_recommendation_ids,
    combine,
    join_business,
    union_all,
)
from stargauge.operators.models import cross_validate, least_squares, sparse_least_squares
from stargauge.operators.subsets import SubsetSources, subset
from stargauge.plans.dimensions import Dimensions, StagedDimensions
from stargauge.plans.modelling import ReviewSets, model_frames, score, train_and_score
from stargauge.sources.readers import SPLIT_PREFIXES, read_splits
from stargauge.sources.staging import stage, stage_all
from stargauge.sources.writers import (
    load_model,
    save_model,
    saved_models,
    write_benchmark,
    write_predictions,
)

REQUIRED_PREFIXES = {name: SPLIT_PREFIXES[name] for name in ("train", "test")}


@dataclass(frozen=True)
class Workspace:
    """Everything that runs start from."""

    train: Split
    test: Split
    everything: Split
    lookup: DataFrame
    dimensions: Dimensions | StagedDimensions
    sets: ReviewSets
    subsets: SubsetSources
    old_test: Split | None = None


def land(split: Split) -> Split:
    """Parse the files once; later scans read only the columns they need."""
    return Split(**stage_all({field.name: getattr(split, field.name) for field in fields(split)}))


def open_workspace(
    spark: SparkSession,
    folder: str,
    prefixes: Mapping[str, str] = REQUIRED_PREFIXES,
    dimensions: Dimensions | None = None,
    train_where: Callable[[], Column] | None = None,
) -> Workspace:
    """Read and clean the entity files; dimensions are computed unless given.

    ``train_where`` (such as ``outliers_out``) limits all training subsets. An old test split is
    read only if ``prefixes`` names it.
    """
    splits, lookup = read_splits(spark, folder, prefixes)
    landed = {name: land(split) for name, split in splits.items()}
    train, test = clean_splits(landed["train"], landed["test"])
    everything = combine(train, test)
    known = dimensions or StagedDimensions(train, everything)
    sets = ReviewSets(train, test, everything, known)
    subsets = SubsetSources(train, test, everything, sets, known, train_where)
    old_test = landed.get("old_test")
    return Workspace(train, test, everything, lookup, known, sets, subsets, old_test)


def fit_subset(
    workspace: Workspace,
    train_subset: str,
    test_subset: str,
    estimator: Estimator | None = None,
    name: str = "LinReg",
    features: list[str] | None = None,
    extra: list[str] | None = None,
    categorical: list[str] | None = None,
    categories: bool = False,
) -> tuple[DataFrame, PipelineModel]:
    """Fit on one named subset and predict every row of another; also the model, for raw rows.

    ``categorical`` names text columns such as ``bus_zip_code`` that become one-hot vectors, and
    ``categories`` adds a vector of the categories most frequent among the test reviews. With
    either, least squares are fitted on the sparse vectors.
    """
    vocabulary = category_words(workspace) if categories else []
    plain = sparse_least_squares() if categorical or vocabulary else least_squares()
    return train_and_score(
        subset(workspace.subsets, train_subset),
        subset(workspace.subsets, test_subset),
        estimator or plain,
        name,
        features,
        extra,
        categorical,
        vocabulary,
    )


def category_words(workspace: Workspace) -> list[str]:
    """The vocabulary of the category vectors: at most 450 categories of the test reviews."""
    reviews = join_business(workspace.test.review, workspace.everything.business, "left")
    return [row["category"] for row in category_vocabulary(reviews).collect()]


def validate_subset(
    workspace: Workspace,
    train_subset: str,
    estimator: Estimator | None = None,
    features: list[str] | None = None,
    extra: list[str] | None = None,
    folds: int = 10,
    share: float = 0.2,
) -> DataFrame:
    """Hold-out size and RMSE of every fold of a training subset."""
    rows = subset(workspace.subsets, train_subset)
    frame, _ = model_frames(rows, rows, features, extra)
    return cross_validate(frame, estimator or least_squares(), folds, share)


def predict_subset(
    workspace: Workspace,
    train_subset: str,
    test_subset: str,
    folder: str,
    submission: str,
    estimator: Estimator | None = None,
    name: str = "LinReg",
    features: list[str] | None = None,
    extra: list[str] | None = None,
    categorical: list[str] | None = None,
    categories: bool = False,
    model_folder: str | None = None,
) -> str:
    """Fit on one named subset, predict another, and write the predictions.

    The fitted model is saved if a folder for it is given, with its scaling, so that
    ``score_saved`` needs nothing else.
    """
    scored, model = fit_subset(
        workspace, train_subset, test_subset, estimator, name, features, extra,
        categorical, categories,
    )
    if model_folder:
        save_model(model, model_folder, name)
    return write_predictions(scored, folder, name, test_subset, submission)


def score_saved(
    workspace: Workspace, model_folder: str, test_subset: str, name: str = "LinReg"
) -> DataFrame:
    """Every row of a named subset with ``predictions_<name>`` by the last model of that name
    that was saved below ``model_folder``."""
    spark = workspace.test.review.sparkSession
    paths = saved_models(spark, model_folder, name)
    if not paths:
        raise FileNotFoundError(f"no model {name} below {model_folder}")
    return score(load_model(paths[-1]), subset(workspace.subsets, test_subset), name)


def submit_benchmarks(workspace: Workspace, folder: str, submission: str) -> list[str]:
    """Write the predictions of the business, user and combined means."""
    means = benchmarks.all_means(workspace.test.review, workspace.train)
    scored = stage(attach_recommendation_ids(means, workspace.lookup), "benchmarks")
    return [
        write_benchmark(scored, folder, name, submission)
        for name in ("bus_mean", "usr_mean", "bus_usr_mean")
    ]


@dataclass(frozen=True)
class Rule:
    """Predict the rows of one subset by a model of another."""

    train_subset: str
    test_subset: str
    features: list[str] | None = None
    extra: list[str] | None = None
    estimator: Estimator | None = None
    categorical: list[str] | None = None
    categories: bool = False


def predict_all(workspace: Workspace, rules: list[Rule]) -> DataFrame:
    """One row per test review: the prediction of the first rule that has one for it, else the
    mean of its business, of its user or of all reviews."""
    key = F.col("review_id")
    found = [
        fit_subset(
            workspace, rule.train_subset, rule.test_subset, rule.estimator, "rule",
            rule.features, rule.extra, rule.categorical, rule.categories,
        )[0].select(key, F.lit(place).alias("place"), F.col("predictions_rule").alias("stars"))
        for place, rule in enumerate(rules)
    ]
    fallback = benchmarks.business_user_mean(workspace.test.review, workspace.train).select(
        key, F.lit(len(rules)).alias("place"), F.col("benchmark_bus_usr_mean").alias("stars")
    )
    known = union_all([*found, fallback]).where("stars IS NOT NULL AND review_id IS NOT NULL")
    # One column a place, so that one hash aggregate finds the first place with its prediction.
    by_place = [
        F.min(F.when(F.col("place") == place, F.col("stars"))) for place in range(len(rules) + 1)
    ]
    return known.groupBy("review_id").agg(F.coalesce(*by_place).alias("stars"))


def submit_all(workspace: Workspace, rules: list[Rule], folder: str, submission: str) -> str:
    """Write one whole submission over all test reviews."""
    return write_predictions(
        predict_all(workspace, rules), folder, "Rules", "all", submission, prediction="stars"
    )
