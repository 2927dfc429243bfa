"""Linear models of all folds from sums of products, gathered in one pass over the rows.

With a leading 1 and the label, the products of a row's numbers add up to a small square matrix.
The matrix of a fold's training rows is that of all rows less that of the rows it holds out, so a
fit, its error on the hold-out, a whole path of penalties and each step of a selection of features
follow from these matrices without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.functions.numeric import held_out
from stargauge.operators.vectors import Rows, entries, linear_model, summed, width_of

KEY = "review_id"
LABEL = "rev_stars"
FEATURES = "features"

# A matrix has the square of this many numbers; wider vectors are fitted without one.
MAX_WIDTH = 2_000
# What is left of a feature, as a share of it, below which it depends on the others.
DEPENDENT = 1e-10


@dataclass(frozen=True)
class FoldSums:
    """Sums of products of ``[1, features, label]``: of all rows, and of each fold's hold-out."""

    whole: np.ndarray
    held: np.ndarray

    def train(self, fold: int) -> np.ndarray:
        return self.whole - self.held[fold]

    @property
    def width(self) -> int:
        return len(self.whole) - 2


def folds_of(key: Column, folds: int, share: float) -> Column:
    """The folds that hold a row out, several or none: independent hold-outs by a hash of fold and
    key."""
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    return F.filter(every, lambda fold: held_out(key, fold, share))


def fold_of(key: Column, folds: int) -> Column:
    """The one of ``folds`` parts that a row belongs to, by a hash of its key, as a list."""
    return F.array(F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))


def fold_sums(df: DataFrame, folds: int, held: Column) -> FoldSums:
    """The sums, in one pass. ``held`` lists the folds that hold a row out. Tasks send one matrix
    per fold, and those are added up in Spark."""
    width = width_of(df, FEATURES)
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features are too many for sums of products, {MAX_WIDTH} at most")
    m = width + 2
    rows = df.select(F.col(LABEL).cast("double").alias("label"), held.alias("held"), *entries(FEATURES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds + 1, m, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, m))
            x[:, 1:-1] = Rows.of(batch).dense(width)
            x[:, -1] = batch.column("label").to_numpy(zero_copy_only=False)
            lists = batch.column("held")
            total[folds] += x.T @ x
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            owners = np.repeat(np.arange(len(x)), sizes.astype(np.int64))
            numbers = lists.flatten().to_numpy(zero_copy_only=False)
            for fold in range(folds):
                out = x[owners[numbers == fold]]
                total[fold] += out.T @ out
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(folds + 1, dtype=np.int32)),
                pa.array(list(total.reshape(folds + 1, -1)), pa.list_(pa.float64())),
            ],
            names=["fold", "part"],
        )

    parts = rows.mapInArrow(gather, "fold int, part array<double>")
    found = np.zeros((folds + 1, m, m))
    for row in summed(parts, ["fold"]).collect():
        found[row["fold"]] = row["part"].toArray().reshape(m, m)
    # Sums of vectors are right but for the last digits; counts are whole.
    found[:, 0, 0] = np.rint(found[:, 0, 0])
    return FoldSums(found[folds], found[:folds])


def centred(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Covariances of the features, those with the label, feature means and label mean."""
    n = sums[0, 0]
    means = sums[0] / n
    around = sums / n - np.outer(means, means)
    return around[1:-1, 1:-1], around[1:-1, -1], means[1:-1], means[-1]


def squared_error(sums: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """Mean squared error of a linear model over the rows of the sums."""
    full = np.concatenate([[-intercept], -weights, [1.0]])
    return max(float(full @ sums @ full), 0.0) / sums[0, 0]


def least_squares_of(sums: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept; of dependent features the smallest weights."""
    inner, outer, means, level = centred(sums)
    scale = np.sqrt(np.maximum(np.diag(inner), 0.0))
    scale[scale == 0] = 1.0
    scaled = inner / np.outer(scale, scale)
    weights = np.linalg.lstsq(scaled, outer / scale, rcond=DEPENDENT)[0] / scale
    return weights, level - weights @ means


def cross_validate_sums(df: DataFrame, folds: int = 5, share: float = 0.15) -> DataFrame:
    """Hold-out size and RMSE of a least-squares fit of every fold, all from one pass. A fold that
    holds nothing out, or everything, has no RMSE."""
    sums = fold_sums(df, folds, folds_of(F.col(KEY), folds, share))
    scores = []
    for fold in range(folds):
        n = int(sums.held[fold][0, 0])
        known = n and sums.train(fold)[0, 0] > 0
        if known:
            weights, intercept = least_squares_of(sums.train(fold))
        error = np.sqrt(squared_error(sums.held[fold], weights, intercept)) if known else None
        scores.append((fold, n, None if error is None else float(error)))
    return df.sparkSession.createDataFrame(scores, "fold int, n bigint, rmse double")


def largest_penalty(df: DataFrame) -> float:
    """The smallest lasso penalty that leaves no feature: ``max |cov(x, y)|``."""
    none = F.array().cast("array<int>")
    return float(np.abs(centred(fold_sums(df, 1, none).whole)[1]).max(initial=0.0))


# ---- path of penalties --------------------------------------------------------------------


def descend(
    inner: np.ndarray, outer: np.ndarray, penalty: float, weights: np.ndarray, tolerance: float
) -> np.ndarray:
    """Minimise ``w inner w / 2 - outer w + penalty |w|`` coordinate by coordinate from
    ``weights``; a constant feature has no weight."""
    w = weights.copy()
    slope = outer - inner @ w
    for _ in range(100_000):
        moved = 0.0
        for k in np.flatnonzero(np.diag(inner) > 0):
            gap = slope[k] + inner[k, k] * w[k]
            new = np.sign(gap) * max(abs(gap) - penalty, 0.0) / inner[k, k]
            step = new - w[k]
            if step:
                slope -= inner[:, k] * step
                w[k] = new
                moved = max(moved, abs(step) * np.sqrt(inner[k, k]))
        if moved <= tolerance:
            break
    return w


@dataclass(frozen=True)
class LassoPath:
    """Penalties from the greatest down, the mean of the folds' squared errors at each, and the
    place of the best."""

    penalties: list[float]
    errors: list[float]
    best: int


class LassoCV(Estimator):
    """Lasso whose penalty is picked by k-fold validation on a log grid below the smallest penalty
    that leaves no feature.

    The rows are read once. Every fold goes down the path from the greatest penalty, each fit
    starting from the last, on the sums of products of its training rows; its error comes from the
    sums of the rows it holds out. The penalty with the smallest mean error is kept, the greatest
    of equal ones, and fitted to all rows. Folds are a hash of the key unless a column of the
    training rows holds them.
    """

    def __init__(
        self,
        folds: int = 3,
        penalties: int = 100,
        span: float = 1e-3,
        fold_column: str = "",
        tolerance: float = 1e-10,
    ) -> None:
        super().__init__()
        self._folds, self._penalties, self._span = folds, penalties, span
        self._column, self._tolerance = fold_column, tolerance
        self.path: LassoPath | None = None

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        held = F.array(self._column) if self._column else fold_of(F.col(KEY), self._folds)
        sums = fold_sums(dataset, self._folds, held)
        inner, outer, means, level = centred(sums.whole)
        top = float(np.abs(outer).max(initial=0.0))
        steps = max(self._penalties - 1, 1)
        grid = [top * self._span ** (i / steps) for i in range(self._penalties)]
        errors = np.zeros((self._folds, len(grid)))
        for fold in range(self._folds):
            part, with_label, fold_means, fold_level = centred(sums.train(fold))
            w = np.zeros(sums.width)
            for i, penalty in enumerate(grid):
                w = descend(part, with_label, penalty, w, self._tolerance)
                errors[fold, i] = squared_error(sums.held[fold], w, fold_level - w @ fold_means)
        mean = errors.mean(axis=0)
        best = int(mean.argmin())
        self.path = LassoPath(grid, mean.tolist(), best)
        w = np.zeros(sums.width)
        for penalty in grid[: best + 1]:
            w = descend(inner, outer, penalty, w, self._tolerance)
        return linear_model(dataset.sparkSession, w, level - w @ means, FEATURES, LABEL)


# ---- selection of features ----------------------------------------------------------------


def sweep(matrix: np.ndarray, k: int) -> np.ndarray:
    """The matrix after its column ``k`` has become a predictor: in the other columns, what it
    explains of them is taken away."""
    pivot = matrix[k, k]
    out = matrix - np.outer(matrix[:, k], matrix[k]) / pivot
    out[k], out[:, k] = matrix[k] / pivot, -matrix[:, k] / pivot
    out[k, k] = 1.0 / pivot
    return out


class _Sweep:
    """One fold of a selection: its training sums swept by the features chosen so far."""

    def __init__(self, train: np.ndarray, held: np.ndarray) -> None:
        # Every model has an intercept: the leading 1 enters first.
        self._swept, self._held = sweep(train, 0), held
        self._left = np.diag(self._swept).copy()
        self._entered: list[int] = []

    def _with(self, k: int) -> tuple[np.ndarray, list[int]]:
        """Sums and features with one more; one that the others explain fully adds nothing."""
        if self._swept[k, k] <= DEPENDENT * max(self._left[k], 1e-300):
            return self._swept, self._entered
        return sweep(self._swept, k), [*self._entered, k]

    def error(self, k: int) -> float:
        """RMSE on the hold-out with a further feature."""
        swept, entered = self._with(k)
        weights = np.zeros(len(swept) - 2)
        weights[np.array(entered, int) - 1] = swept[entered, -1]
        return float(np.sqrt(squared_error(self._held, weights, swept[0, -1])))

    def enter(self, k: int) -> None:
        self._swept, self._entered = self._with(k)


def select_forward(
    df: DataFrame,
    candidates: Sequence[str],
    folds: int = 3,
    share: float = 0.2,
    least_steps: int = 1,
) -> DataFrame:
    """``step, feature, mean_rmse``: add the feature that lowers the mean RMSE of the folds most,
    until none lowers it, but go on for ``least_steps`` steps.

    ``df`` has the key, the label and a vector of all candidates, in order. Its rows are read once.
    For each fold the sums of the training rows are swept by the features chosen so far, so a
    further feature costs one pivot, and its error comes from the sums of the rows held out. Of
    equal features the first by name is taken. Folds without rows on either side do not count.
    """
    sums = fold_sums(df, folds, folds_of(F.col(KEY), folds, share))
    parts = [
        _Sweep(sums.train(f), sums.held[f])
        for f in range(folds)
        if sums.held[f][0, 0] > 0 and sums.train(f)[0, 0] > 0
    ]
    left = {name: place for place, name in enumerate(candidates, 1)}
    history: list[tuple[int, str, float]] = []
    while parts and left:
        best, name = min((float(np.mean([p.error(k) for p in parts])), n) for n, k in left.items())
        if len(history) >= least_steps and best >= history[-1][2]:
            break
        for part in parts:
            part.enter(left[name])
        del left[name]
        history.append((len(history) + 1, name, best))
    return df.sparkSession.createDataFrame(history, "step int, feature string, mean_rmse double")
