"""Linear fits that read the rows again and again: conjugate gradients on wide sparse vectors,
stochastic gradient steps and support vector regression.

Each pass is one Spark job over a written table; what travels between passes are vectors as long as
the weights, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators.vectors import (
    Rows,
    entries,
    linear_model,
    packed,
    summed,
    unpacked,
    width_of,
)
from stargauge.sources.staging import stage

KEY = "review_id"
LABEL = "rev_stars"
FEATURES = "features"


def _part(*vectors: np.ndarray) -> pa.RecordBatch:
    joined = np.concatenate(vectors)
    return pa.RecordBatch.from_arrays([pa.array([joined], pa.list_(pa.float64()))], names=["part"])


def _total(rows: DataFrame, gather) -> np.ndarray:
    """The sum of the vectors that ``gather`` makes of the batches of each task."""
    found = summed(rows.mapInArrow(gather, "part array<double>")).first()
    return found["part"].toArray()


# ---- conjugate gradients ------------------------------------------------------------------


class SparseLeastSquares(Estimator):
    """Least squares, with a squared penalty ``alpha |w|^2`` if asked for, for any number of
    features; meant for wide sparse vectors.

    Conjugate gradients on the normal equations: every pass multiplies the rows with a direction
    and sums them with the products, so no matrix of the features is formed. Columns are scaled by
    their length, and labels taken around their mean. Of dependent columns, as all values of a
    one-hot vector beside the intercept, the smallest weights are found: a row without an entry,
    such as one of an unseen value, is predicted by the mean. Passes end when the slope is ``tolerance`` of what it was
    at zero weights, ``passes`` at the latest.
    """

    def __init__(self, alpha: float = 0.0, tolerance: float = 1e-10, passes: int = 500) -> None:
        super().__init__()
        self._alpha, self._tolerance, self._passes = alpha, tolerance, passes
        self.passes_taken = 0

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        width = width_of(dataset, FEATURES)
        if not width:
            raise ValueError("no training rows")
        columns = [F.col(LABEL).cast("double").alias("label"), *entries(FEATURES)]
        rows = stage(dataset.select(*columns), "sparse-rows")

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, sums, squares = np.zeros(width), np.zeros(width), np.zeros(width)
            ends = np.zeros(2)
            for batch in batches:
                x, y = Rows.of(batch), batch.column("label").to_numpy(zero_copy_only=False)
                ones = np.ones(len(y))
                slope += x.transposed_dot(y, width)
                sums += x.transposed_dot(ones, width)
                squares += np.bincount(x.indices, x.values**2, width)
                ends += [len(y), y.sum()]
            yield _part(slope, sums, squares, ends)

        first = _total(rows, start)
        slope, sums, squares = first[: 3 * width].reshape(3, width)
        n, label_sum = np.rint(first[3 * width]), first[3 * width + 1]
        # Around the label's mean, so that a row without any entry is predicted by it.
        level = label_sum / n
        # The intercept is one more column, of ones, without a penalty.
        lengths = np.sqrt(np.r_[squares, n])
        lengths[lengths == 0] = 1.0
        penalty = np.r_[np.full(width, self._alpha), 0.0] / lengths**2

        def product(direction: np.ndarray) -> np.ndarray:
            plain = direction / lengths

            def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(width + 1)
                for batch in batches:
                    x = Rows.of(batch)
                    along = x.dot(plain[:-1]) + plain[-1]
                    out[:-1] += x.transposed_dot(along, width)
                    out[-1] += along.sum()
                yield _part(out)

            return _total(rows, multiply) / lengths + penalty * direction

        weights = np.zeros(width + 1)
        rest = np.r_[slope - level * sums, 0.0] / lengths
        direction, size = rest.copy(), rest @ rest
        least = self._tolerance**2 * size
        self.passes_taken = 0
        while size > least and self.passes_taken < self._passes:
            image = product(direction)
            step = size / (direction @ image)
            weights += step * direction
            rest -= step * image
            before, size = size, rest @ rest
            direction = rest + size / before * direction
            self.passes_taken += 1
        weights /= lengths
        intercept = level + weights[-1]
        return linear_model(dataset.sparkSession, weights[:-1], intercept, FEATURES, LABEL)


# ---- shards -------------------------------------------------------------------------------


def _sharded(df: DataFrame, rows_per_shard: int, seed: int) -> tuple[DataFrame, int, int, int]:
    """``shard, mark, label, size, indices, values``, staged, with shards of about
    ``rows_per_shard`` rows; number of rows, of shards, and width.

    A shard is dealt by a hash of the key and of the row's content, so equal keys do not fill one,
    and in a shard rows are ordered by another hash: what a pass does is the same for any
    partitioning of the input.
    """
    width = width_of(df, FEATURES)
    columns = [F.col(LABEL).cast("double").alias("label"), *entries(FEATURES)]
    mark = F.xxhash64(F.lit(seed), F.col(KEY), F.col("label"), F.to_json(F.struct("indices", "values")))
    rows = stage(df.select(KEY, *columns).withColumn("mark", mark), "fit-rows")
    n = rows.count()
    shards = max(1, -(-n // rows_per_shard))
    dealt = F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", dealt).drop(KEY), n, shards, width


def _order(marks: np.ndarray, seed: int, epoch: int) -> np.ndarray:
    """Another order in every epoch, decided by the rows' marks alone."""
    salt = int.from_bytes(hashlib.md5(f"{seed}|{epoch}".encode()).digest()[:8], "little") | 1
    mixed = marks.astype(np.uint64) * np.uint64(salt)
    return np.lexsort((marks, mixed ^ (mixed >> np.uint64(32))))


class _Shard:
    """The rows of a packed shard."""

    def __init__(self, row: dict, width: int) -> None:
        self.marks = np.frombuffer(row["marks"], np.int64)
        self.y = np.frombuffer(row["labels"], np.float64)
        self.x = Rows(
            np.frombuffer(row["offsets"], np.int64),
            np.frombuffer(row["places"], np.int64),
            np.frombuffer(row["numbers"], np.float64),
        )
        self.width = width


_PACKED = "shard int, n bigint, marks binary, labels binary, offsets binary, places binary, numbers binary"


def _packed(df: DataFrame) -> DataFrame:
    """One row per shard, written once: passes read it without a shuffle."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mark", "ascending"), ("label", "ascending")]).combine_chunks()
        x = Rows.of(table)
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "n": pa.array([table.num_rows], pa.int64()),
                "marks": [table["mark"].to_numpy().tobytes()],
                "labels": [table["label"].to_numpy().tobytes()],
                "offsets": [x.offsets.astype(np.int64).tobytes()],
                "places": [x.indices.astype(np.int64).tobytes()],
                "numbers": [x.values.astype(np.float64).tobytes()],
            }
        )

    return stage(df.groupBy("shard").applyInArrow(pack, _PACKED), "packed-rows")


# ---- stochastic gradient ------------------------------------------------------------------


class StochasticGradient(Estimator):
    """Linear regression by stochastic gradient steps, with a squared penalty ``alpha |w|^2 / 2``.

    Every epoch each shard starts from the shared weights and steps through its rows in an order of
    its own, ``batch`` rows a step, with steps that shrink as ``eta / (1 + eta alpha t)`` and, from
    epoch to epoch, by ``decay``; the weights of all shards are averaged by their rows. Shards
    and orders come from hashes of the rows, and averages are taken in the order of the shards, so
    a fit repeats for any partitioning. Epochs end when no weight moves by more than ``tolerance``.

    With standardised features, weights and intercept lie within 0.02 of the closed form on the
    test data; the bound is a property of the decay, not of the number of partitions.
    """

    def __init__(
        self,
        alpha: float = 0.001,
        epochs: int = 60,
        eta: float = 0.05,
        decay: float = 0.9,
        batch: int = 16,
        rows_per_shard: int = 65_536,
        tolerance: float = 1e-5,
        seed: int = 0,
    ) -> None:
        super().__init__()
        self._alpha, self._epochs, self._eta, self._decay = alpha, epochs, eta, decay
        self._batch, self._rows_per_shard = batch, rows_per_shard
        self._tolerance, self._seed = tolerance, seed
        self.epochs_taken = 0

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        rows, n, _, width = _sharded(dataset, self._rows_per_shard, self._seed)
        if not n:
            raise ValueError("no training rows")
        packed = _packed(rows)
        alpha, batch, seed = self._alpha, self._batch, self._seed

        def steps(shard: _Shard, start: np.ndarray, eta: float, epoch: int) -> np.ndarray:
            w = start.copy()
            x = shard.x.dense(width + 1)
            x[:, -1] = 1.0
            order = _order(shard.marks, seed, epoch)
            x, y = x[order], shard.y[order]
            shrunk = np.r_[np.full(width, alpha), 0.0]
            for t, at in enumerate(range(0, len(y), batch)):
                part = x[at : at + batch]
                slope = part.T @ (part @ w - y[at : at + batch]) / len(part) + shrunk * w
                w -= eta / (1.0 + eta * alpha * t) * slope
            return w

        weights = np.zeros(width + 1)
        eta = self._eta
        for epoch in range(self._epochs):
            current, size = weights, eta

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for some in batches:
                    for row in some.to_pylist():
                        moved = steps(_Shard(row, width), current, size, epoch)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["shard"]], pa.int32()), pa.array([row["n"]], pa.int64()),
                             pa.array([moved], pa.list_(pa.float64()))],
                            names=["shard", "n", "part"],
                        )

            moved = packed.mapInArrow(run, "shard int, n bigint, part array<double>")
            weighted = moved.select("n", F.transform("part", lambda v: v * F.col("n")).alias("part"))
            new = summed(weighted.select("part")).first()["part"].toArray() / n
            change = float(np.abs(new - weights).max())
            weights, eta = new, eta * self._decay
            self.epochs_taken = epoch + 1
            if change <= self._tolerance:
                break
        return linear_model(dataset.sparkSession, weights[:-1], weights[-1], FEATURES, LABEL)


# ---- support vector regression ------------------------------------------------------------

# Features whose matrix of products every task can sum.
NEWTON_WIDTH = 512
# Rounds of Newton steps, and those in a row without descent, after which planes take over.
NEWTON_ROUNDS, NEWTON_FAILS = 50, 2
# Weights tried in one pass: a whole step and its halves.
_HALVES = 2.0 ** -np.arange(12)[:, None]


def _lowest(slopes: np.ndarray, gains: np.ndarray, enough: float) -> tuple[float, np.ndarray]:
    """The least of ``|w|^2 / 2`` plus the greatest of the planes ``gains - slopes w``, from below,
    and its weights.

    Steps of an interior point; any mean of the planes gives a bound, that of the best is returned.
    """
    planes, size = slopes.shape
    share = np.full(planes, 1 / planes)
    w = share @ slopes
    level = (gains - slopes @ w).max() + 0.01 * max(np.abs(gains).max(), 1.0)
    room = slopes @ w + level - gains
    bound, at = -np.inf, w
    border = np.column_stack([slopes, np.ones(planes)])
    ridge = np.diag(np.r_[np.ones(size), 0.0])
    for _ in range(80):
        mean = share / share.sum()
        point = mean @ slopes
        value = gains @ mean - point @ point / 2
        if value > bound:
            bound, at = float(value), point
        if w @ w / 2 + (gains - slopes @ w).max() - bound <= enough:
            break
        aim = 0.1 * (share @ room) / planes
        lack = slopes @ w + level - gains - room
        weight = share / room
        pull = (aim - share * room - share * lack) / room
        rest = np.r_[w - share @ slopes, 1 - share.sum()]
        step = np.linalg.solve(border.T @ (weight[:, None] * border) + ridge, border.T @ pull - rest)
        if not np.isfinite(step).all():
            break
        more = border @ step + lack
        moved = (aim - share * room - share * more) / room
        ratio = max(float((-moved / share).max()), float((-more / room).max()))
        length = min(1.0, 0.99 / ratio) if ratio > 0 else 1.0
        w, level = w + length * step[:-1], level + length * step[-1]
        share, room = share + length * moved, room + length * more
    return bound, at


class SupportVector(Estimator):
    """Linear support vector regression: ``|w|^2 / 2 + cost * sum max(0, |y - wx| - epsilon)``,
    the intercept being one more weight, on a column of ones.

    Dual coordinate ascent: every shard goes through its rows in an order of its own and moves each
    row's multiplier to its optimum against the shard's view of the weights, in which its own moves
    count ``shards`` times, so that the moves of all shards can be added. The shared weights are
    the rows summed with their multipliers. Multipliers are written with their shard after each
    round. Rounds end when the duality gap is ``gap`` of the primal value, which proves how far
    from the optimum the fit can be; the last gap is kept in ``gap_left``.

    Up to ``NEWTON_WIDTH`` features, whose matrix of products is small, take Newton steps on a loss
    with rounded corners instead: a pass sums slopes and curves, nothing is kept per row, and the
    number of passes does not grow with the rows. The corners are sharpened until the gap of the
    loss as it is, with the multipliers that the slopes are, is small enough. Where sharp corners
    leave no curve to step by, planes below the loss end the fit: each pass gives one for every
    weights tried, the lowest point above all of them is tried next, and its value bounds the gap.
    """

    def __init__(
        self,
        cost: float = 1.0,
        epsilon: float = 0.1,
        gap: float = 1e-3,
        rounds: int = 200,
        passes: int = 10,
        rows_per_shard: int = 65_536,
        seed: int = 0,
    ) -> None:
        super().__init__()
        self._cost, self._epsilon, self._gap = cost, epsilon, gap
        self._rounds, self._passes = rounds, passes
        self._rows_per_shard, self._seed = rows_per_shard, seed
        self.gap_left, self.rounds_taken = np.inf, 0

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        width = width_of(dataset, FEATURES)
        if 0 < width <= NEWTON_WIDTH:
            return self._fit_narrow(dataset, width)
        return self._fit_wide(dataset)

    def _fit_narrow(self, dataset: DataFrame, width: int) -> LinearRegressionModel:
        rows = packed(dataset, width, FEATURES, LABEL, "support-rows")
        cost, epsilon = self._cost, self._epsilon
        size = width + 1

        def sums(corner: float, places: np.ndarray) -> np.ndarray:
            """For each of some weights the loss with rounded corners; for the first also the loss,
            the multipliers' part of the dual value, their sum of rows and the sum of curves."""

            def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                round_loss, ends = np.zeros(len(places)), np.zeros(2)
                slope, curve = np.zeros(size), np.zeros((size, size))
                for x, y in unpacked(batches, width):
                    x = np.column_stack([x, np.ones(len(y))])
                    lack = y[:, None] - x @ places.T
                    over = np.maximum(np.abs(lack) - epsilon, 0.0)
                    edge = np.minimum(over, corner)
                    round_loss += cost * (edge * (over - edge / 2)).sum(axis=0) / corner
                    beta = cost / corner * edge[:, 0] * np.sign(lack[:, 0])
                    slope += x.T @ beta
                    ends += cost * over[:, 0].sum(), beta @ y - epsilon * np.abs(beta).sum()
                    bent = x[(over[:, 0] > 0) & (over[:, 0] < corner)]
                    curve += cost / corner * (bent.T @ bent)
                yield _part(round_loss, ends, slope, curve.ravel())

            return added(gather)

        def planes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each of some weights the loss, and the plane that touches it there: its value at
            zero weights and its slopes."""

            def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                losses, touching = np.zeros(len(places)), np.zeros((len(places), size + 1))
                for x, y in unpacked(batches, width):
                    x = np.column_stack([x, np.ones(len(y))])
                    lack = y[:, None] - x @ places.T
                    over = np.maximum(np.abs(lack) - epsilon, 0.0)
                    beta = cost * np.sign(lack) * (over > 0)
                    losses += cost * over.sum(axis=0)
                    touching[:, 0] += beta.T @ y - epsilon * np.abs(beta).sum(axis=0)
                    touching[:, 1:] += beta.T @ x
                yield _part(losses, touching.ravel())

            losses, touching = np.split(added(gather), [len(places)])
            return losses, touching.reshape(len(places), -1)

        def added(gather) -> np.ndarray:
            parts = rows.mapInArrow(gather, "part array<double>")
            # One short vector per task; longer ones are added up in tasks first.
            if size * size <= 4_096:
                return np.sum([row["part"] for row in parts.collect()], axis=0)
            return summed(parts).first()["part"].toArray()

        weights = best = np.zeros(size)
        least, most = np.inf, -np.inf
        corner, told, fails, known = 1.0, None, 0, []
        for number in range(self._rounds):
            self.rounds_taken = number
            if number >= NEWTON_ROUNDS or fails >= NEWTON_FAILS:
                bound, lowest = _lowest(
                    np.array([plane[1:] for plane in known]),
                    np.array([plane[0] for plane in known]),
                    0.01 * self._gap * abs(least),
                )
                most = max(most, bound)
                self.gap_left = (least - most) / max(abs(least), 1e-300)
                if self.gap_left <= self._gap:
                    break
                tried = best + _HALVES * (lowest - best)
                losses, touching = planes(tried)
                known += list(touching)
                values = losses + (tried * tried).sum(axis=1) / 2
                if values.min() < least:
                    least, best = float(values.min()), tried[int(np.argmin(values))]
                continue
            if told is None:
                told = sums(corner, weights[None, :])
            length = weights @ weights / 2
            *losses, loss, gain = told[: -size - size * size]
            summed_rows, curve = np.split(told[-size - size * size :], [size])
            primal, dual = length + loss, gain - summed_rows @ summed_rows / 2
            if primal < least:
                least, best = primal, weights
            most = max(most, dual)
            known.append(np.r_[gain, summed_rows])
            self.gap_left = (least - most) / max(abs(least), 1e-300)
            if self.gap_left <= self._gap:
                break
            slope = weights - summed_rows
            step = np.linalg.solve(np.eye(size) + curve.reshape(size, size), slope)
            here, told = length + losses[0], None
            # What this corner can still gain is far less than the gap asked for.
            if slope @ step <= 0.1 * self._gap * max(abs(least), 1e-300):
                corner /= 8
                continue
            # The whole step mostly wins, and its sums are the next round's.
            tried = weights - _HALVES * step
            found = sums(corner, tried)
            values = found[: len(tried)] + (tried * tried).sum(axis=1) / 2
            if values.min() >= here:
                # Rounding hides the descent, or next to no row is in a corner.
                corner /= 8
                fails += 1
                continue
            fails = 0
            weights = tried[int(np.argmin(values))]
            told = found if values.argmin() == 0 else None
        return linear_model(dataset.sparkSession, best[:-1], best[-1], FEATURES, LABEL)

    def _fit_wide(self, dataset: DataFrame) -> LinearRegressionModel:
        rows, n, shards, width = _sharded(dataset, self._rows_per_shard, self._seed)
        if not n:
            raise ValueError("no training rows")
        packed = _packed(rows)
        cost, epsilon, passes, seed = self._cost, self._epsilon, self._passes, self._seed
        zero = F.expr("unhex(repeat('00', cast(8 * n as int)))").alias("betas")
        state = packed.select("*", zero)

        def ascend(shard: _Shard, beta: np.ndarray, w: np.ndarray, number: int) -> np.ndarray:
            """Moves ``beta`` and returns the change of the weights."""
            offsets, places, numbers = shard.x.offsets, shard.x.indices, shard.x.values
            squares = np.add.reduceat(np.r_[numbers**2, 0.0], offsets[:-1]) if len(numbers) else 0.0
            squares = np.where(np.diff(offsets) > 0, squares, 0.0) + 1.0
            view, change = w.copy(), np.zeros(width + 1)
            for turn in range(passes):
                for i in _order(shard.marks, seed, number * passes + turn):
                    at = slice(offsets[i], offsets[i + 1])
                    where, x = places[at], numbers[at]
                    curve = shards * squares[i]
                    lack = shard.y[i] - x @ view[where] - view[-1]
                    # The optimum of the multiplier between -cost and cost, epsilon pulling it to 0.
                    target = beta[i] + lack / curve
                    pulled = np.sign(target) * max(abs(target) - epsilon / curve, 0.0)
                    move = min(max(pulled, -cost), cost) - beta[i]
                    if move:
                        beta[i] += move
                        view[where] += shards * move * x
                        view[-1] += shards * move
                        change[where] += move * x
                        change[-1] += move
            return change

        def values(shard: _Shard, beta: np.ndarray, w: np.ndarray) -> list[float]:
            lack = np.abs(shard.y - shard.x.dot(w[:-1]) - w[-1])
            loss = cost * np.maximum(lack - epsilon, 0.0).sum()
            return [loss, beta @ shard.y - epsilon * np.abs(beta).sum()]

        weights = np.zeros(width + 1)
        for number in range(self._rounds):
            current = weights

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for some in batches:
                    for i, row in enumerate(some.to_pylist()):
                        shard = _Shard(row, width)
                        beta = np.frombuffer(row["betas"], np.float64).copy()
                        told = values(shard, beta, current)
                        change = ascend(shard, beta, current, number)
                        kept = some.slice(i, 1).drop_columns(["betas"])
                        columns = [*kept.columns, pa.array([beta.tobytes()], pa.binary()),
                                   pa.array([np.r_[change, told]], pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(
                            columns, names=[*kept.schema.names, "betas", "part"]
                        )

            state = stage(
                state.drop("part").mapInArrow(run, f"{_PACKED}, betas binary, part array<double>"),
                f"support-{number}",
            )
            told = summed(state.select("part")).first()["part"].toArray()
            # Both values are those of the weights that the round started from.
            length = current @ current / 2
            primal, dual = length + told[-2], told[-1] - length
            self.gap_left = (primal - dual) / max(abs(primal), 1e-300)
            self.rounds_taken = number
            if self.gap_left <= self._gap:
                break
            weights = current + told[: width + 1]
        return linear_model(dataset.sparkSession, weights[:-1], weights[-1], FEATURES, LABEL)
