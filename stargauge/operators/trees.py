"""Extremely randomised regression trees, grown level by level.

The cut of a feature in a node is drawn by a hash between the least and the greatest value the node
has, so no bins or quantiles are needed. One aggregate a level gives the sums on both sides of every
drawn cut, a second one the bounds of all features in the nodes that the best cuts make, from which
the next level's cuts are drawn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators.vectors import Rows, entries, packed, unpacked, width_of

LABEL = "rev_stars"
FEATURES = "features"


def drawn(seed: int, tree: int, node: int, feature: int) -> float:
    """A number from 0 to 1, below 1, for the cut of a feature; the first 32 bits of a hash."""
    digest = hashlib.md5(f"{seed}|{tree}|{node}|{feature}".encode()).hexdigest()
    return int(digest[:8], 16) / 2**32


@dataclass
class Tree:
    """Nodes of a tree; the children of a node follow each other. A leaf has ``feature`` -1."""

    feature: np.ndarray
    cut: np.ndarray
    first: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = self.feature < 0
        # A leaf leads to itself.
        feature = np.where(leaf, 0, self.feature)
        cut = np.where(leaf, np.inf, self.cut)
        first = np.where(leaf, np.arange(len(leaf)), self.first)
        values, begins = x.ravel(), np.arange(len(x)) * x.shape[1]
        node = np.zeros(len(x), np.int64)
        while True:
            above = values.take(begins + feature.take(node)) > cut.take(node)
            after = first.take(node) + above
            if np.array_equal(after, node):
                return node
            node = after


class TreesModel(Model):
    """The mean of the leaves that a row falls into, as ``prediction``."""

    def __init__(self, trees: list[Tree], width: int) -> None:
        super().__init__()
        self.trees, self.numFeatures = trees, width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, width = self.trees, self.numFeatures

        @F.pandas_udf("double")
        def predict(values: pd.Series, indices: pd.Series) -> pd.Series:
            batch = pa.table(
                {
                    "values": pa.array(list(values), pa.list_(pa.float64())),
                    "indices": pa.array(list(indices), pa.list_(pa.int32())),
                }
            )
            x = Rows.of(batch).dense(width)
            return pd.Series(sum(tree.value[tree.leaf_of(x)] for tree in trees) / len(trees))

        _, indices, values = entries(FEATURES)
        return dataset.withColumn("prediction", predict(values, indices))


class _Growing:
    """A tree while it grows: its open nodes are those of the last level that can be cut."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.feature, self.cut, self.first, self.value = [-1], [0.0], [0], [0.0]
        self.open: list[int] = []
        self.cuts = np.zeros((0, 0))

    def tree(self) -> Tree:
        return Tree(
            np.array(self.feature), np.array(self.cut), np.array(self.first), np.array(self.value)
        )

    def offer(self, nodes: list[tuple], seed: int) -> None:
        """Opens the nodes ``place, n, total, squares, low, high`` that can be cut, and draws a cut
        for each of their features."""
        self.open, cuts = [], []
        for place, n, total, squares, low, high in nodes:
            self.value[place] = total / n
            if n < 2 or squares - total * total / n <= 1e-12 * max(squares, 1.0):
                continue
            if not (high > low).any():
                continue
            drawn_cuts = [
                low[k] + drawn(seed, self.number, place, k) * (high[k] - low[k])
                for k in range(len(low))
            ]
            # Rounding must not leave a side empty; a constant feature is never cut.
            kept = np.where(np.array(drawn_cuts) < high, drawn_cuts, low)
            cuts.append(np.where(high > low, kept, np.inf))
            self.open.append(place)
        self.cuts = np.array(cuts).reshape(len(cuts), -1)


_SIDES = "place bigint, n bigint, total double, squares double, low array<double>, high array<double>"


class ExtraTrees(Estimator):
    """The mean of ``trees`` trees of at most ``depth`` levels. In each node one cut per feature is
    drawn, and that with the least squared error is taken, the first feature of equal ones.

    Rows are staged once and read twice a level, and once to begin with: for the sums on both sides
    of every drawn cut, and for the bounds of the nodes that the best cuts make. Tasks find the node
    of a row from the trees so far, so nothing is kept per row. Cuts come from a hash of seed, tree,
    node and feature, so a fit repeats for any partitioning.
    """

    def __init__(self, trees: int = 30, depth: int = 10, seed: int = 0) -> None:
        super().__init__()
        self._trees, self._depth, self._seed = trees, depth, seed

    def _fit(self, dataset: DataFrame) -> TreesModel:
        width = width_of(dataset, FEATURES)
        if not width:
            raise ValueError("no training rows")
        rows = packed(dataset, width, FEATURES, LABEL, "tree-rows")
        growing = [_Growing(t) for t in range(self._trees)]
        # Without cuts yet, the trees share the bounds of all rows.
        root = _bounds(rows, growing[:1], [[0]], width)[0]
        for tree in growing:
            tree.offer(root, self._seed)
        for level in range(self._depth):
            wanted = [tree for tree in growing if tree.open]
            if not wanted:
                break
            found = _sums(rows, wanted, width)
            children = [_cut(tree, *sums) for tree, sums in zip(wanted, found, strict=True)]
            if level + 1 < self._depth:
                for tree, nodes in zip(wanted, _bounds(rows, wanted, children, width), strict=True):
                    tree.offer(nodes, self._seed)
        return TreesModel([tree.tree() for tree in growing], width)


def _cut(tree: _Growing, n: np.ndarray, total: np.ndarray) -> list[int]:
    """Cuts the open nodes at their best cut, by the rows and labels per open node, feature and side;
    returns the children."""
    children = []
    for i, place in enumerate(tree.open):
        best, gain = -1, -np.inf
        for k in range(n.shape[1]):
            if n[i, k].all():
                kept = sum(total[i, k, side] * total[i, k, side] / n[i, k, side] for side in (0, 1))
                if kept > gain:
                    best, gain = k, kept
        tree.feature[place], tree.cut[place] = best, float(tree.cuts[i, best])
        tree.first[place] = len(tree.feature)
        for side in (0, 1):
            children.append(len(tree.feature))
            tree.feature.append(-1)
            tree.cut.append(0.0)
            tree.first.append(0)
            tree.value.append(total[i, best, side] / n[i, best, side])
    return children


def _numbered(growing: list[_Growing], nodes: list[list[int]]) -> list[tuple[Tree, np.ndarray]]:
    """Each tree with the number of a node among those named, -1 for the others."""
    plans = []
    for tree, named in zip(growing, nodes, strict=True):
        where = np.full(len(tree.feature), -1)
        where[named] = np.arange(len(named))
        plans.append((tree.tree(), where))
    return plans


def _sums(rows: DataFrame, growing: list[_Growing], width: int) -> list[tuple]:
    """For each tree the rows, and the sum of their labels, per open node, feature and side of the
    cut."""
    plans = _numbered(growing, [tree.open for tree in growing])
    cuts = [tree.cuts for tree in growing]
    sizes = [drawn_cuts.size * 2 for drawn_cuts in cuts]
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, starts[-1]))
        features = np.arange(width)
        for x, y in unpacked(batches, width):
            for (tree, where), drawn_cuts, start, size in zip(plans, cuts, starts, sizes, strict=False):
                node = where[tree.leaf_of(x)]
                inside = np.flatnonzero(node >= 0)
                node = node[inside]
                side = x[inside] > drawn_cuts[node]
                at = ((node[:, None] * width + features) * 2 + side).ravel()
                sums[0, start : start + size] += np.bincount(at, minlength=size)
                labels = np.repeat(y[inside], width)
                sums[1, start : start + size] += np.bincount(at, labels, size)
        given = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(given), pa.array(sums[0, given].astype(np.int64)), pa.array(sums[1, given])],
            names=["place", "n", "total"],
        )

    parts = rows.mapInArrow(gather, "place bigint, n bigint, total double")
    merged = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # As many rows as the trees have open cuts, whatever the number of rows.
    sums = np.zeros((2, starts[-1]))
    for row in merged.collect():
        sums[:, row["place"]] = row["n"], row["total"]
    parted = [sums[:, start:end].reshape(2, -1, width, 2) for start, end in pairwise(starts)]
    return [tuple(part) for part in parted]


def _bounds(
    rows: DataFrame, growing: list[_Growing], nodes: list[list[int]], width: int
) -> list[list[tuple]]:
    """For each tree its named nodes as ``place, n, total, squares, low, high``: sums of the labels
    and bounds of the features of their rows."""
    plans = _numbered(growing, nodes)
    starts = np.concatenate([[0], np.cumsum([len(named) for named in nodes])])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, starts[-1]))
        low = np.full((starts[-1], width), np.inf)
        high = np.full((starts[-1], width), -np.inf)
        for x, y in unpacked(batches, width):
            for (tree, where), start in zip(plans, starts, strict=False):
                node = where[tree.leaf_of(x)]
                inside = np.flatnonzero(node >= 0)
                if not len(inside):
                    continue
                # Small numbers are sorted by their digits.
                node = node[inside].astype(np.min_scalar_type(len(where)))
                order = np.argsort(node, kind="stable")
                node, inside = node[order], inside[order]
                begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                at = start + node[begins].astype(np.int64)
                labels, values = y[inside], x[inside]
                sums[0, at] += np.diff(np.r_[begins, len(node)])
                sums[1, at] += np.add.reduceat(labels, begins)
                sums[2, at] += np.add.reduceat(labels * labels, begins)
                low[at] = np.minimum(low[at], np.minimum.reduceat(values, begins))
                high[at] = np.maximum(high[at], np.maximum.reduceat(values, begins))
        given = np.flatnonzero(sums[0])
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(given),
                pa.array(sums[0, given].astype(np.int64)),
                pa.array(sums[1, given]),
                pa.array(sums[2, given]),
                pa.array(list(low[given]), kind),
                pa.array(list(high[given]), kind),
            ],
            names=["place", "n", "total", "squares", "low", "high"],
        )

    parts = rows.mapInArrow(gather, _SIDES)
    merged = parts.groupBy("place").agg(
        *(F.sum(name).alias(name) for name in ("n", "total", "squares")),
        F.array(*(F.min(F.get("low", F.lit(k))) for k in range(width))).alias("low"),
        F.array(*(F.max(F.get("high", F.lit(k))) for k in range(width))).alias("high"),
    )
    # As many rows as the trees have open nodes, whatever the number of rows.
    found = {
        row["place"]: (row["n"], row["total"], row["squares"], np.array(row["low"]), np.array(row["high"]))
        for row in merged.collect()
    }
    return [
        [(place, *found[start + i]) for i, place in enumerate(named)]
        for named, start in zip(nodes, starts.tolist(), strict=False)
    ]
