"""Estimators, cross-validation and prediction on review sets.

Frames carry a vector ``features`` and the label ``rev_stars``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.concurrent import side_by_side
from stargauge.functions.numeric import held_out, rmse
from stargauge.operators.boosting import BoostedTrees
from stargauge.operators.features import assemble
from stargauge.operators.folded import (
    LassoCV,
    cross_validate_sums,
    largest_penalty,
    select_forward,
)
from stargauge.operators.gradient_fits import SparseLeastSquares, StochasticGradient, SupportVector
from stargauge.operators.joins import union_all
from stargauge.operators.trees import ExtraTrees
from stargauge.sources.staging import stage

KEY = "review_id"
LABEL = "rev_stars"
FEATURES = "features"
COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL}


def least_squares() -> LinearRegression:
    """Ordinary least squares."""
    return _linear(0.0, 0.0)


def _linear(reg: float, ratio: float, **more) -> LinearRegression:
    """A linear model on unscaled penalties.

    The solver reads the rows once and works on their covariances, for up to 4,096 features;
    it is named, so that penalties are scaled for the solver that runs.
    """
    settings = {"solver": "normal", "tol": 1e-10, "maxIter": 1000, **more}
    return LinearRegression(
        regParam=reg, elasticNetParam=ratio, standardization=False, **settings, **COLUMNS
    )


def _label_moments(train: DataFrame) -> tuple[int, float]:
    row = train.agg(F.count(LABEL).alias("n"), F.stddev_pop(LABEL).alias("std")).first()
    return row["n"], row["std"]


def ridge(train: DataFrame, alpha: float = 1.0) -> LinearRegression:
    """Minimise ``|y - Xw|^2 + alpha |w|^2``.

    The solver divides the label by its deviation, which weakens a squared penalty by it.
    """
    n, std = _label_moments(train)
    return _linear(alpha * std / n, 0.0)


def lasso(alpha: float = 1.0) -> LinearRegression:
    """Minimise ``|y - Xw|^2 / 2n + alpha |w|``."""
    return _linear(alpha, 1.0)


def elastic_net(train: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.5) -> LinearRegression:
    """Minimise ``|y - Xw|^2 / 2n + alpha (l1_ratio |w| + (1 - l1_ratio) |w|^2 / 2)``."""
    _, std = _label_moments(train)
    l1 = alpha * l1_ratio
    l2 = alpha * (1 - l1_ratio) * std
    return _linear(l1 + l2, l1 / (l1 + l2) if l1 + l2 else 0.0)


def lasso_cv(
    folds: int = 3, penalties: int = 100, span: float = 1e-3, fold_column: str = ""
) -> LassoCV:
    """Lasso with the penalty picked by k-fold validation on a log grid below the largest, all
    folds and penalties from one pass over the rows.

    A row's fold is a hash of its key unless a column of the training rows holds it.
    """
    return LassoCV(folds, penalties, span, fold_column)


def forest(trees: int = 50, depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=0, **COLUMNS)


def forest_classifier(trees: int = 50, depth: int = 10) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=0, **COLUMNS)


def boosted_trees(rounds: int = 100, depth: int = 3, rate: float = 0.1) -> BoostedTrees:
    return BoostedTrees(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=0, **COLUMNS)


def gradient_linear(
    train: DataFrame, alpha: float = 0.001, iterations: int = 800
) -> LinearRegression:
    """Iteratively fitted linear model with a squared penalty ``alpha |w|^2 / 2``."""
    # This solver divides the label by its sample deviation.
    std = train.agg(F.stddev_samp(LABEL)).first()[0]
    return _linear(alpha * std, 0.0, solver="l-bfgs", tol=1e-6, maxIter=iterations)


def extra_trees(trees: int = 30, depth: int = 10, seed: int = 0) -> ExtraTrees:
    return ExtraTrees(trees, depth, seed)


def stochastic_gradient(alpha: float = 0.001, epochs: int = 60, seed: int = 0) -> StochasticGradient:
    return StochasticGradient(alpha, epochs, seed=seed)


def support_vector(cost: float = 1.0, epsilon: float = 0.1) -> SupportVector:
    return SupportVector(cost, epsilon)


def sparse_least_squares(alpha: float = 0.0) -> SparseLeastSquares:
    """Least squares, or ridge, for vectors too wide for ``least_squares``."""
    return SparseLeastSquares(alpha)


def reads_key(estimator: Estimator) -> bool:
    """Whether a fit may read the key of its rows, as folds and shards by a hash of it do."""
    return not isinstance(estimator, LinearRegression | ExtraTrees)


def univariate_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line through all rows."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"),
    )


def fit_predict(
    train: DataFrame, test: DataFrame, estimator: Estimator, name: str
) -> tuple[DataFrame, Model]:
    """Fit on ``train`` and put the predictions for ``test`` into ``predictions_<name>``.

    Every test row is kept; one without a feature vector has no prediction.
    """
    model = estimator.fit(train)
    known = F.col(FEATURES).isNotNull()
    width = model.numFeatures
    stand_in = array_to_vector(F.array_repeat(F.lit(0.0), width))
    filled = test.withColumn("_given", F.col(FEATURES)).withColumn(
        FEATURES, F.when(known, F.col(FEATURES)).otherwise(stand_in)
    )
    scored = model.transform(filled)
    prediction = F.when(F.col("_given").isNotNull(), F.col("prediction"))
    column = f"predictions_{name}"
    kept = [F.col("_given").alias(c) if c == FEATURES else F.col(c) for c in test.columns]
    return scored.select(*kept, prediction.alias(column)), model


def with_folds(df: DataFrame, folds: int, share: float, key: str = KEY) -> DataFrame:
    """One row per fold that holds the row out; a row may be held out by several or none.

    Folds are independent random hold-outs, decided by a hash of fold and key.
    """
    every = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return every.where(held_out(F.col(key), F.col("fold"), share))


def _plain(estimator: Estimator) -> bool:
    """Whether an estimator is least squares without a penalty, which sums of products give."""
    return isinstance(estimator, LinearRegression) and not estimator.getRegParam()


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    folds: int = 5,
    share: float = 0.15,
    parallelism: int = 4,
) -> DataFrame:
    """Hold-out size and RMSE of every fold.

    Least squares take one pass over the rows for all folds. Other models are fitted fold by fold,
    several at a time, on rows that are written once, so a lost executor costs a read.
    """
    if _plain(estimator):
        return cross_validate_sums(df, folds, share)
    spark = df.sparkSession
    rows = stage(df.select(KEY, LABEL, FEATURES), "validated-rows")

    def predictions(fold: int) -> DataFrame:
        out = held_out(F.col(KEY), F.lit(fold), share)
        scored = estimator.copy().fit(rows.where(~out)).transform(rows.where(out))
        return scored.select(F.lit(fold).alias("fold"), LABEL, "prediction")

    scores = (
        union_all(side_by_side(spark, predictions, range(folds), parallelism))
        .groupBy("fold")
        .agg(F.count("*").alias("n"), rmse(F.col(LABEL), F.col("prediction")).alias("rmse"))
        .collect()
    )
    return spark.createDataFrame(sorted(scores), "fold int, n bigint, rmse double")


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("rmse").alias("mean_rmse"))


def benchmark_predictions(
    df: DataFrame, prediction: Column, folds: int, share: float, fold: int | None = None
) -> DataFrame:
    """Hold-out rows with a benchmark's prediction, for all folds or one."""
    rows = with_folds(df, folds, share)
    if fold is not None:
        rows = rows.where(F.col("fold") == fold)
    return rows.select(KEY, "fold", LABEL, prediction.alias("prediction"))


def cross_validate_benchmark(
    df: DataFrame, prediction: Column, folds: int = 5, share: float = 0.15
) -> DataFrame:
    """Hold-out size and RMSE of a benchmark, all folds in one pass and one small shuffle."""
    return (
        benchmark_predictions(df, prediction, folds, share)
        .groupBy("fold")
        .agg(F.count("*").alias("n"), rmse(F.col(LABEL), F.col("prediction")).alias("rmse"))
    )


def cross_validate_training_mean(df: DataFrame, folds: int = 5, share: float = 0.15) -> DataFrame:
    """As above for the mean of the rows outside the fold's hold-out.

    Sums over all rows minus sums over the hold-out give that mean, so the training rows of
    the folds are never formed.
    """
    whole = df.agg(
        F.struct(F.count(LABEL).alias("n"), F.sum(LABEL).alias("total"))
    ).scalar()
    label = F.col(LABEL).cast("double")
    held = (
        with_folds(df, folds, share)
        .groupBy("fold")
        .agg(
            F.count(LABEL).alias("n"),
            F.sum(label).alias("total"),
            F.sum(label * label).alias("squares"),
        )
    )
    mean = F.try_divide(whole["total"] - F.col("total"), whole["n"] - F.col("n"))
    error = F.col("squares") - 2 * mean * F.col("total") + F.col("n") * mean * mean
    # Rounding may leave a perfect fold slightly below zero.
    square = F.when(error > 0, error / F.col("n")).when(error <= 0, F.lit(0.0))
    return held.select("fold", "n", F.sqrt(square).alias("rmse"))


def forward_selection(
    df: DataFrame,
    candidates: list[str],
    estimator: Callable[[], Estimator] = least_squares,
    folds: int = 3,
    share: float = 0.2,
    parallelism: int = 4,
    least_steps: int = 1,
) -> DataFrame:
    """Add the feature that lowers the mean RMSE most, until no feature lowers it, but for
    ``least_steps`` steps at least.

    Least squares read the rows once for all steps, candidates and folds. Other models are fitted
    for each of them, on rows that are written once.
    """
    spark = df.sparkSession
    if _plain(estimator()):
        return select_forward(assemble(df, candidates), candidates, folds, share, least_steps)
    rows = stage(df.select(KEY, LABEL, *candidates), "selection-rows")
    chosen: list[str] = []
    history: list[tuple[int, str, float]] = []

    def score(name: str) -> tuple[float, str]:
        frame = assemble(rows, [*chosen, name], FEATURES)
        scores = cross_validate(frame, estimator(), folds, share, parallelism=1)
        return mean_score(scores).first()["mean_rmse"], name

    while len(chosen) < len(candidates):
        left = [name for name in candidates if name not in chosen]
        best, name = min(side_by_side(spark, score, left, parallelism))
        if len(history) >= least_steps and best >= history[-1][2]:
            break
        chosen.append(name)
        history.append((len(chosen), name, best))
    return spark.createDataFrame(history, "step int, feature string, mean_rmse double")
