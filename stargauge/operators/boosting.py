"""Boosted regression trees on binned rows, one pass of array work a level.

Candidate cuts, gains and leaves are those of Spark ML's ``GBTRegressor``, and so is the fitted model.
What differs is the pass over the rows: they are binned once into arrays of small codes, and a level's
sums per node, feature and bin are counted array by array instead of object by object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stargauge.operators.vectors import Rows, entries, width_of
from stargauge.sources.scratch import scratch_path

# Rounds after which the rows are written anew with what the trees so far predict for them.
_REWRITTEN = 10
# Rows that cuts are looked for in, at least, as in Spark ML.
_SAMPLED = 10_000
_EPSILON = np.finfo(float).eps
_INVALID = -np.finfo(float).max


@dataclass
class _Node:
    """A node with the count, sum and sum of squares of its rows; a leaf until it has children."""

    stats: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[_Node, _Node] | None = None

    @property
    def mean(self) -> float:
        return float(self.stats[1] / self.stats[0])

    @property
    def impurity(self) -> float:
        return float(_variance(self.stats))

    def leaves(self) -> list[_Node]:
        """From the lowest values of the cut features to the highest."""
        if self.children is None:
            return [self]
        return [leaf for child in self.children for leaf in child.leaves()]

    def places(self, codes: np.ndarray) -> np.ndarray:
        """For every row, whose codes are a column, the place of its leaf among all leaves."""
        kind = np.min_scalar_type(len(self.leaves()) - 1)

        def place(node: _Node, first: int) -> np.ndarray:
            if node.children is None:
                return kind.type(first)
            low, high = node.children
            below, above = place(low, first), place(high, first + len(low.leaves()))
            # All bits of the numbers, or none: much faster than a choice row by row.
            mask = np.negative((codes[node.feature] > node.bin).astype(kind))
            return below ^ (mask & (below ^ above))

        return np.broadcast_to(place(self, 0), codes.shape[1])

    def spread(self, codes: np.ndarray, values: list) -> np.ndarray:
        """For every row the value of its leaf."""
        return np.array(values).take(self.places(codes))

    def pruned(self) -> _Node:
        """Without cuts between leaves of one value."""
        if self.children is None:
            return self
        below, above = (child.pruned() for child in self.children)
        if below.children is None and above.children is None and below.mean == above.mean:
            return _Node(self.stats)
        return _Node(self.stats, self.gain, self.feature, self.bin, (below, above))


def _variance(stats: np.ndarray) -> np.ndarray:
    count, total, squares = stats
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 0, (squares - total * total / count) / count, 0.0)


def feature_cuts(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most some ``most`` cuts of a feature by the non-zero values of a sample of ``expected`` rows;
    midway between neighbours if those are few, else where the ranks are nearest to even steps."""
    distinct, counts = np.unique(values, return_counts=True)
    zeros = expected - len(values)
    if zeros > _EPSILON * len(values) * 100:
        place = np.searchsorted(distinct, 0.0)
        distinct, counts = np.insert(distinct, place, 0.0), np.insert(counts.astype(float), place, zeros)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) <= most:
        return between
    step = expected / (most + 1)
    kept, wanted = [], step
    ranks = np.cumsum(counts).tolist()
    for i, (before, after) in enumerate(zip(ranks, ranks[1:], strict=False)):
        if abs(before - wanted) < abs(after - wanted):
            kept.append(between[i])
            wanted += step
    return np.array(kept)


def sampled_cuts(
    dataset: DataFrame, vector: str, bins: int, seed: int, width: int, rows: int
) -> list[np.ndarray]:
    """The cuts of every feature, by the sample of the rows that Spark ML takes."""
    bins = min(bins, rows)
    wanted = max(bins * bins, _SAMPLED)
    share = wanted / rows if wanted < rows else 1.0
    sample = dataset.select(vector)
    if share < 1:
        spark = dataset.sparkSession
        drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        kept = sample._jdf.toJavaRDD().sample(False, share, drawn)
        sample = DataFrame(spark._jsparkSession.createDataFrame(kept, sample._jdf.schema()), spark)
    expected = share * rows

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        found = feature_cuts(group["value"].to_numpy(), expected, bins - 1)
        return pd.DataFrame({"feature": group["feature"].iloc[:1], "cuts": [found.tolist()]})

    found = (
        sample.select(F.posexplode(vector_to_array(vector)).alias("feature", "value"))
        .where(F.col("value") != 0)
        .groupBy("feature")
        .applyInPandas(cut, "feature int, cuts array<double>")
        .collect()
    )
    cuts = [np.array([])] * width
    for row in found:
        cuts[row["feature"]] = np.array(row["cuts"])
    return cuts


_CELL = "codes binary, labels binary, fitted binary"
# Cells are read a few at a time: one holds as many rows as an Arrow batch of the session.
_READING = {
    "spark.sql.parquet.columnarReaderBatchSize": "16",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8",
}


def _reader(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, but for those of reading cells."""
    own = spark.newSession()
    for name, value in {**spark.conf.getAll, **_READING}.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def _written(cells: DataFrame, spark: SparkSession, reader: SparkSession) -> DataFrame:
    path = scratch_path(spark, "binned-rows")
    cells.write.parquet(path, mode="error")
    return reader.read.schema(_CELL).parquet(path)


def _cell(codes: np.ndarray, labels: np.ndarray, fitted: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([column.tobytes()], pa.binary()) for column in (codes, labels, fitted)]
    return pa.RecordBatch.from_arrays(columns, names=["codes", "labels", "fitted"])


def _binned(dataset: DataFrame, vector: str, label: str, cuts: list[np.ndarray]) -> DataFrame:
    """The rows as cells of an Arrow batch each: a line of codes per feature, and the labels."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            if batch.column("values").null_count or not np.isfinite(labels).all():
                raise ValueError("a training row lacks its features or a finite label")
            x = Rows.of(batch).dense(len(cuts))
            if not np.isfinite(x).all():
                raise ValueError("a training row has a feature that is not finite")
            codes = np.empty((len(cuts), len(x)), np.uint8)
            for k, at in enumerate(cuts):
                codes[k] = np.searchsorted(at, x[:, k])
            yield _cell(codes, labels, np.zeros(len(x)))

    columns = [F.col(label).cast("double").alias("label"), *entries(vector)]
    return dataset.select(*columns).mapInArrow(pack, _CELL)


def _cells(
    batches: Iterator[pa.RecordBatch], width: int, trees: list[tuple[_Node, float]]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, labels and what is fitted so far, that of ``trees`` included."""
    for batch in batches:
        for cell in zip(*batch.columns, strict=True):
            codes, labels, fitted = (part.as_buffer() for part in cell)
            codes = np.frombuffer(codes, np.uint8).reshape(width, -1)
            fitted = np.frombuffer(fitted)
            for tree, weight in trees:
                fitted = fitted + tree.spread(codes, [leaf.mean * weight for leaf in tree.leaves()])
            yield codes, np.frombuffer(labels), fitted


def _refitted(cells: DataFrame, width: int, trees: list[tuple[_Node, float]]) -> DataFrame:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, labels, fitted in _cells(batches, width, trees):
            yield _cell(codes, labels, fitted)

    return cells.mapInArrow(fit, _CELL)


def _sums(
    cells: DataFrame,
    trees: list[tuple[_Node, float]],
    root: _Node,
    open_nodes: list[_Node],
    shape: tuple[int, int],
    first: bool,
) -> np.ndarray:
    """Count, sum and sum of squares of the residuals per open node, feature and bin."""
    width, bins = shape
    numbers = {id(node): i for i, node in enumerate(open_nodes)}
    # Rows of other leaves fall into a place of their own behind the open nodes.
    size = (len(open_nodes) + 1) * bins
    starts = [numbers.get(id(leaf), len(open_nodes)) * bins for leaf in root.leaves()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, width, size))
        for codes, labels, fitted in _cells(batches, width, trees):
            residuals = labels if first else 2.0 * (labels - fitted)
            squares = residuals * residuals
            start = root.spread(codes, starts)
            for k in range(width):
                at = start + codes[k]
                sums[0, k] += np.bincount(at, minlength=size)
                sums[1, k] += np.bincount(at, residuals, size)
                sums[2, k] += np.bincount(at, squares, size)
        sums = sums.reshape(3, -1)
        given = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(column) for column in (given, *sums[:, given])],
            names=["place", "n", "total", "squares"],
        )

    kinds = "place bigint, n double, total double, squares double"
    names = ("n", "total", "squares")
    merged = cells.mapInArrow(gather, kinds).groupBy("place").agg(*(F.sum(c).alias(c) for c in names))
    # As many rows as the open nodes have bins, whatever the number of rows.
    sums = np.zeros((3, width * size))
    for row in merged.collect():
        sums[:, row["place"]] = row["n"], row["total"], row["squares"]
    by_node = sums.reshape(3, width, len(open_nodes) + 1, bins)[:, :, :-1]
    return by_node.transpose(2, 0, 1, 3)


def _cut(node: _Node, sums: np.ndarray, cuts: list[np.ndarray], least: int, least_gain: float) -> None:
    """Gives a node the children of its best cut, the first feature's and lowest of equal ones."""
    best = None
    for k, at in enumerate(cuts):
        if not len(at):
            continue
        running = np.cumsum(sums[:, k, : len(at) + 1], axis=1)
        left, right = running[:, :-1], running[:, -1:] - running[:, :-1]
        n = left[0] + right[0]
        if node.stats is None:
            node.stats = left[:, 0] + right[:, 0]
        gains = node.impurity - left[0] / n * _variance(left) - right[0] / n * _variance(right)
        few = (left[0] < least) | (right[0] < least)
        gains = np.where(few | (gains < least_gain), _INVALID, gains)
        i = int(np.argmax(gains))
        if best is None or gains[i] > best[0]:
            best = gains[i], k, i, left[:, i].copy(), right[:, i].copy()
    if best and best[0] > 0:
        node.gain, node.feature, node.bin = float(best[0]), best[1], best[2]
        node.children = _Node(best[3]), _Node(best[4])


class BoostedTrees(GBTRegressor):
    """``GBTRegressor`` for squared errors on numbers, fitted on binned rows that are staged once and
    read once a level. Settings that ask for more, like drawn rows, go to Spark ML's own fit.

    What the trees so far predict for a row is found from its codes again in every pass, and written
    every few rounds, so nothing is kept in memory per row.
    """

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        vector, label = self.getFeaturesCol(), self.getLabelCol()
        rows = dataset.count()
        width = width_of(dataset, vector)
        if not rows or not width or not self._plain(dataset.schema[vector].metadata):
            return super()._fit(dataset)
        cuts = sampled_cuts(dataset, vector, self.getMaxBins(), self.getSeed(), width, rows)
        spark = dataset.sparkSession
        reader = _reader(spark)
        cells = _written(_binned(dataset, vector, label, cuts), spark, reader)
        shape = width, max(len(at) for at in cuts) + 1
        trees: list[tuple[_Node, float]] = []
        done = 0
        for m in range(self.getMaxIter()):
            if m - done == _REWRITTEN:
                cells, done = _written(_refitted(cells, width, trees[done:]), spark, reader), m
            root = self._grown(cells, trees[done:], cuts, shape, first=not m)
            trees.append((root.pruned(), self.getStepSize() if m else 1.0))
        return self._copyValues(self._model(spark, trees, cuts))

    def _plain(self, metadata: dict) -> bool:
        """Whether no setting or categorical feature asks for more than the passes here do."""
        kinds = metadata.get("ml_attr", {}).get("attrs", {})
        unset = (self.weightCol, self.validationIndicatorCol)
        return (
            self.getLossType() == "squared"
            and self.getSubsamplingRate() == 1.0
            and self.getFeatureSubsetStrategy() == "all"
            and self.getMinWeightFractionPerNode() == 0.0
            and 2 <= self.getMaxBins() <= 128
            and not any(self.isSet(param) for param in unset)
            and not {"nominal", "binary"} & set(kinds)
        )

    def _grown(
        self,
        cells: DataFrame,
        trees: list[tuple[_Node, float]],
        cuts: list[np.ndarray],
        shape: tuple[int, int],
        first: bool,
    ) -> _Node:
        least, least_gain = self.getMinInstancesPerNode(), self.getMinInfoGain()
        root = _Node(None)
        open_nodes = [root]
        # A tree of no levels still has the mean of all rows.
        for level in range(max(self.getMaxDepth(), 1)):
            sums = _sums(cells, trees, root, open_nodes, shape, first)
            if root.stats is None and (not self.getMaxDepth() or not any(map(len, cuts))):
                root.stats = sums[0, :, 0].sum(axis=1)
                break
            for node, part in zip(open_nodes, sums, strict=True):
                _cut(node, part, cuts, least, least_gain)
            grown = [child for node in open_nodes for child in node.children or ()]
            open_nodes = [child for child in grown if abs(child.impurity) >= _EPSILON]
            if not open_nodes:
                break
        return root

    def _model(
        self, spark, trees: list[tuple[_Node, float]], cuts: list[np.ndarray]
    ) -> GBTRegressionModel:
        """The trees as an ordinary model, which scores, is saved and is loaded as one."""
        jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
        parts = jvm.org.apache.spark.ml.tree
        calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
        regression = jvm.org.apache.spark.ml.regression

        def made(node: _Node):
            stats = new_array(jvm.double, 3)
            for i, number in enumerate(node.stats.tolist()):
                stats[i] = number
            held = calculator(stats, int(node.stats[0]))
            if node.children is None:
                return parts.LeafNode(node.mean, node.impurity, held)
            children = [made(child) for child in node.children]
            split = parts.ContinuousSplit(node.feature, float(cuts[node.feature][node.bin]))
            return parts.InternalNode(node.mean, node.impurity, node.gain, *children, split, held)

        grown = new_array(regression.DecisionTreeRegressionModel, len(trees))
        weights = new_array(jvm.double, len(trees))
        for i, (tree, weight) in enumerate(trees):
            uid = f"dtr_{self.uid}_{i}"
            grown[i] = regression.DecisionTreeRegressionModel(uid, made(tree), len(cuts))
            weights[i] = float(weight)
        model = GBTRegressionModel(
            regression.GBTRegressionModel(self.uid, grown, weights, len(cuts))
        )
        model._resetUid(self.uid)
        return model
