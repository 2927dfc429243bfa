"""Nearest-neighbour regression by a kd partition of the training rows.

The space is cut into cells of bounded size. A test row first looks at its home cell; the distance
of its k-th neighbour there, or a bound from the sizes of the cells around it, says which other
cells can hold a nearer row, and only those are visited. They are counted in before rows are sent,
so that little more than the rows around the k-th distance travels. Cells side by side make a region,
to which a test row travels once, and which answers once for all its cells. The answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from stargauge.operators.vectors import Rows, as_bytes, entries, width_of
from stargauge.sources.staging import stage

KEY = "review_id"
LABEL = "rev_stars"
FEATURES = "features"

# Rows of a cell, unless that makes more cells than the tree may have; it travels with the tasks.
CELL_ROWS = 4_096
MAX_CELLS = 65_536
# Rows that one round of cuts is chosen from.
SAMPLE_ROWS = 100_000
# Test rows whose distances to a cell are computed at once; few, so that they stay in the cache.
TEST_ROWS = 32
# Regions that the rows should make at least, and rows of a region at most, as a task holds one.
REGIONS = 64
REGION_ROWS = 131_072
# Visits of one region that a task answers; more are dealt to further tasks.
REGION_VISITS = 262_144
ROUNDS = 40
# Parts of a reach that rows are counted in before any is sent, and how often at most: each time within
# the part that the last one found, as long as that holds more than a few rows.
STEPS = 32
COUNTINGS = 4
FEW = 32
COUNTS = [f"n_{step}" for step in range(STEPS)]


@dataclass(frozen=True)
class Tree:
    """Cuts of the space. Node 0 is the root; a leaf has ``axis`` -1 and ``below`` as its cell."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row: rows at a cut lie below it."""
        node = np.zeros(len(x), np.int64)
        while True:
            axis = self.axis[node]
            inner = np.flatnonzero(axis >= 0)
            if not len(inner):
                return self.below[node]
            at = node[inner]
            low = x[inner, axis[inner]] <= self.cut[at]
            node[inner] = np.where(low, self.below[at], self.above[at])


@dataclass(frozen=True)
class Cells:
    """The tree, and for each cell the box of its rows and their number."""

    tree: Tree
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """The box of the rows below each node. Children follow their parents."""
        nodes = len(self.tree.axis)
        low, high = np.empty((nodes, self.low.shape[1])), np.empty((nodes, self.low.shape[1]))
        for node in range(nodes - 1, -1, -1):
            one, two = self.tree.below[node], self.tree.above[node]
            if self.tree.axis[node] < 0:
                low[node], high[node] = self.low[one], self.high[one]
            else:
                low[node] = np.minimum(low[one], low[two])
                high[node] = np.maximum(high[one], high[two])
        return low, high

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node the number of the region it is the top of, else -1, and for each cell its
        region. A region is all that lies below a node, if that is not too many rows, or a cell."""
        below, above = self.tree.below, self.tree.above
        leaf = self.tree.axis < 0
        rows = np.zeros(len(leaf), np.int64)
        for node in range(len(leaf) - 1, -1, -1):
            rows[node] = self.rows[below[node]] if leaf[node] else rows[below[node]] + rows[above[node]]
        limit = min(REGION_ROWS, int(rows[0]) // REGIONS)
        tops, of_cell = np.full(len(leaf), -1), np.full(len(self.rows), -1)
        pending = [(0, -1)]
        while pending:
            node, inside = pending.pop()
            if inside < 0 and (leaf[node] or rows[node] <= limit):
                inside = tops[node] = tops.max() + 1
            if leaf[node]:
                of_cell[below[node]] = inside
            else:
                pending += [(below[node], inside), (above[node], inside)]
        return tops, of_cell

    def within(
        self, x: np.ndarray, reach: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], tops: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a row of ``x`` and a region whose box is not farther than the row's reach, by
        descending the tree with the rows that still reach a node. ``boxes`` and ``tops`` are those
        of the nodes."""
        low, high = boxes
        rows, regions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pending = [(0, np.arange(len(x)))]
        while pending:
            node, near = pending.pop()
            near = near[_gap(x[near], low[node], high[node]) <= reach[near]]
            if not len(near):
                continue
            if tops[node] >= 0:
                rows.append(near)
                regions.append(np.full(len(near), tops[node]))
            else:
                pending += [(self.tree.below[node], near), (self.tree.above[node], near)]
        return np.concatenate(rows), np.concatenate(regions)

    def enough(self, x: np.ndarray, k: int) -> float:
        """A squared distance from a point within which at least ``k`` rows lie, if there are as
        many: that of the nearest whole boxes that hold them."""
        far = _summed(np.maximum(np.abs(x - self.low), np.abs(x - self.high)))
        order = np.argsort(far, kind="stable")
        place = np.searchsorted(np.cumsum(self.rows[order]), k)
        return float(far[order[place]]) if place < len(order) else np.inf


def _summed(gaps: np.ndarray) -> np.ndarray:
    """Squares summed in the order of the features, as distances are."""
    total = np.zeros(len(gaps))
    for k in range(gaps.shape[1]):
        total += gaps[:, k] * gaps[:, k]
    return total


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every row to a box."""
    return _summed(np.maximum(np.maximum(low - x, x - high), 0.0))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all points, summed in the order of the features."""
    out = np.zeros((len(x), len(points)))
    for k in range(x.shape[1]):
        gap = x[:, k, None] - points[None, :, k]
        out += gap * gap
    return out


def _nearly(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances by one product of matrices, less than ``_slack`` from the true ones."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ points.T) + (points * points).sum(axis=1)


def _slack(x: np.ndarray, points: np.ndarray) -> float:
    largest = max(np.abs(x).max(initial=0.0), np.abs(points).max(initial=0.0))
    return 1e-13 * (1 + x.shape[1]) * float(largest) ** 2


# ---- cells --------------------------------------------------------------------------------


class _Grower:
    """The tree while cells are cut further."""

    def __init__(self) -> None:
        self.nodes: list[list] = [[-1, 0.0, 0, 0]]
        self.leaf_of = {0: 0}

    def split(self, cell: int, axis: int, cut: float) -> tuple[int, int]:
        """Cuts a cell; its number stays with the part below, the part above gets a new one."""
        node, other = self.leaf_of[cell], len(self.leaf_of)
        self.nodes += [[-1, 0.0, cell, 0], [-1, 0.0, other, 0]]
        self.nodes[node] = [axis, cut, len(self.nodes) - 2, len(self.nodes) - 1]
        self.leaf_of[cell], self.leaf_of[other] = len(self.nodes) - 2, len(self.nodes) - 1
        return cell, other

    def tree(self) -> Tree:
        axis, cut, below, above = zip(*self.nodes)
        return Tree(np.array(axis), np.array(cut, float), np.array(below), np.array(above))

    def cut(self, cell: int, x: np.ndarray, low: np.ndarray, high: np.ndarray, parts: int) -> None:
        """Cuts a cell into about ``parts`` by medians of a sample of its rows. A sample that is a
        single point is cut between the bounds of the cell instead."""
        if parts < 2:
            return
        inside = high - low
        if not inside.any():
            return
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(len(low))
        if spread.any():
            axis = int(np.argmax(spread))
            cut = float(np.median(x[:, axis]))
            top = x[:, axis].max()
            if cut >= top:
                # Most rows share the greatest value: it gets a part of its own.
                cut = float(x[x[:, axis] < top, axis].max())
        else:
            axis = int(np.argmax(inside))
            cut = float(low[axis] + inside[axis] / 2)
            if not low[axis] <= cut < high[axis]:
                cut = float(low[axis])
        first, second = self.split(cell, axis, cut)
        under = x[:, axis] <= cut
        share = under.mean() if len(x) and spread.any() else 0.5
        ends, starts = high.copy(), low.copy()
        ends[axis] = starts[axis] = cut
        self.cut(first, x[under], low, ends, round(parts * share))
        self.cut(second, x[~under], starts, high, round(parts * (1 - share)))


def _located(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """The rows with their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = tree.cell_of(Rows.of(batch).dense(width))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells.astype(np.int32))],
                    names=[*batch.schema.names, "cell"],
                )

    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    return rows.mapInArrow(run, schema)


def _regional(located: DataFrame, of_cell: np.ndarray) -> DataFrame:
    """The rows with their region, by their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions = of_cell[batch.column("cell").to_numpy()].astype(np.int32)
            yield batch.append_column("region", pa.array(regions))

    return located.mapInArrow(run, f"{_kinds(located)}, region int")


def _boxes(located: DataFrame, width: int) -> DataFrame:
    """Per cell: number of rows, and least and greatest value of each feature, combined in the
    tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell = Rows.of(batch).dense(width), batch.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            x, cell = x[order], cell[order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell[starts]),
                    pa.array(np.diff(np.r_[starts, len(cell)])),
                    pa.array(list(np.minimum.reduceat(x, starts)), kind),
                    pa.array(list(np.maximum.reduceat(x, starts)), kind),
                ],
                names=["cell", "n", "low", "high"],
            )

    parts = located.mapInArrow(run, "cell int, n bigint, low array<double>, high array<double>")
    return parts.groupBy("cell").agg(
        F.sum("n").alias("n"),
        *(F.min(F.get("low", F.lit(k))).alias(f"low_{k}") for k in range(width)),
        *(F.max(F.get("high", F.lit(k))).alias(f"high_{k}") for k in range(width)),
    )


def _measured(located: DataFrame, width: int, cells: int) -> tuple[np.ndarray, ...]:
    rows = np.zeros(cells, np.int64)
    low, high = np.full((cells, width), np.inf), np.full((cells, width), -np.inf)
    for row in _boxes(located, width).collect():
        at = row["cell"]
        rows[at] = row["n"]
        low[at] = [row[f"low_{k}"] for k in range(width)]
        high[at] = [row[f"high_{k}"] for k in range(width)]
    return rows, low, high


def grow(rows: DataFrame, width: int, cell_rows: int = CELL_ROWS) -> tuple[Cells, DataFrame]:
    """Cells of at most ``cell_rows`` rows, and the rows with their cell.

    Cuts are medians of a sample of bounded size. Then the rows of each cell are counted, and cells
    above the size are sampled and cut again, until none is left but such as hold a single
    point. For very many rows cells are larger, so that there are at most ``MAX_CELLS`` or so: the
    tree and the boxes, which travel with the tasks, have a fixed bound.
    """
    total = rows.count()
    limit = max(cell_rows, -(-2 * total // MAX_CELLS))
    grower = _Grower()
    located = _located(rows, grower.tree(), width)
    for number in range(ROUNDS):
        count, low, high = _measured(located, width, len(grower.leaf_of))
        large = np.flatnonzero((count > limit) & (high > low).any(axis=1))
        if not len(large):
            break
        share = min(1.0, SAMPLE_ROWS / int(count[large].sum()))
        mark = F.pmod(F.xxhash64(F.lit(number), "key"), F.lit(1 << 30))
        # At most as many cells as there are, each named by its number.
        inside = F.col("cell").isin([int(cell) for cell in large])
        sample = located.where(inside & (mark < int(share * (1 << 30)))).toArrow()
        cells = sample.column("cell").to_numpy()
        points = Rows.of(sample).dense(width) if sample.num_rows else np.zeros((0, width))
        for cell in large:
            parts = max(2, -(-2 * int(count[cell]) // limit))
            grower.cut(int(cell), points[cells == cell], low[cell], high[cell], parts)
        located = _located(rows, grower.tree(), width)
    else:
        raise RuntimeError("cells do not become smaller")
    return Cells(grower.tree(), low, high, count), located


# ---- search -------------------------------------------------------------------------------


def _cells_of(train: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The cells of a region, each with the places of its rows."""
    cell = train.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    for places in np.split(order, starts[1:]):
        yield int(cell[places[0]]), places


def _blocks(
    asked: np.ndarray, reach: np.ndarray, train: pa.Table, points: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every cell of a region, a few of the test rows that reach it at a time: their places, the
    places of the cell's rows, and the nearly exact distances."""
    for _, places in _cells_of(train):
        held = points[places]
        near = np.flatnonzero(_gap(asked, held.min(axis=0), held.max(axis=0)) <= reach)
        for start in range(0, len(near), TEST_ROWS):
            some = near[start : start + TEST_ROWS]
            yield some, places, _nearly(asked[some], held)


def _home_reach(test: pa.Table, train: pa.Table, width: int, k: int) -> pa.Table:
    """Per test row the distance of its k-th row in its home, or the reach it came with."""
    schema = pa.schema([("row", pa.int64()), ("reach", pa.float64())])
    if not test.num_rows:
        return schema.empty_table()
    reach = test.column("reach").to_numpy().copy()
    if train.num_rows >= k:
        points, asked = (Rows.of(table).dense(width) for table in (train, test))
        homes = test.column("cell").to_numpy()
        for cell, places in _cells_of(train):
            if len(places) < k:
                continue
            held, at = points[places], np.flatnonzero(homes == cell)
            for start in range(0, len(at), TEST_ROWS):
                some = at[start : start + TEST_ROWS]
                far = distances(asked[some], held)
                reach[some] = np.minimum(reach[some], np.partition(far, k - 1, axis=1)[:, k - 1])
    return pa.table([test.column("row"), reach], schema=schema)


def _steps(reach: np.ndarray, floor: np.ndarray, width: int) -> np.ndarray:
    """For each reach the squared distances up to which rows are counted, the reach itself last;
    balls of equal shares of the volume, or of that beyond the floor, which is the first then."""
    inner = np.divide(floor, reach, out=np.zeros(len(reach)), where=(floor > 0) & (reach > 0))
    inner = np.minimum(inner, 1.0)[:, None] ** (width / 2)
    whole, beyond = np.arange(1, STEPS + 1) / STEPS, np.arange(STEPS) / (STEPS - 1)
    shares = inner + (1 - inner) * np.where(floor[:, None] > 0, beyond, whole)
    steps = reach[:, None] * shares ** (2 / width)
    steps[:, -1] = reach
    return steps


def _counted(test: pa.Table, train: pa.Table, width: int) -> pa.Table:
    """How many rows of one region lie in each step of the reach of the test rows that visit it. Rows
    closer to the end of a step than rounding may count to the next: ``_bounded`` allows for it."""
    schema = pa.schema([("row", pa.int64()), *((name, pa.int32()) for name in COUNTS)])
    if not test.num_rows or not train.num_rows:
        return schema.empty_table()
    points, asked = (Rows.of(table).dense(width) for table in (train, test))
    reach = test.column("reach").to_numpy()
    steps = _steps(reach, test.column("floor").to_numpy(), width)
    counts = np.zeros((len(asked), STEPS), np.int32)
    slack = _slack(asked, points)
    for some, _, far in _blocks(asked, reach, train, points):
        for i, line in zip(some, far, strict=True):
            near = line[line <= reach[i] + slack]
            found = np.searchsorted(steps[i], near)
            counts[i] += np.bincount(np.minimum(found, STEPS - 1), minlength=STEPS)
    some = np.flatnonzero(counts.any(axis=1))
    rows = test.column("row").take(pa.array(some))
    return pa.table([rows, *counts[some].T], schema=schema)


def _nearest(owner: np.ndarray, far: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest of every owner, of equally near ones those of the first places."""
    order = np.lexsort((place, far, owner))
    sorted_owner = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner) < k]


def _search(test: pa.Table, train: pa.Table, width: int, k: int) -> pa.Table:
    """The rows of one region near the test rows that visit it: those up to ``floor`` as one row with
    their number and the sum of their labels, at distance -1, and each of those from there to
    ``reach``, at most ``k``; at equal distances the smaller keys."""
    schema = pa.schema(
        [("row", pa.int64()), ("distance", pa.float64()),
         ("key", train.schema.field("key").type), ("label", pa.float64()), ("n", pa.int64())]
    )
    if not test.num_rows or not train.num_rows:
        return schema.empty_table()
    # In the order of the keys, so that a stable sort leaves ties to the smaller ones.
    train = train.sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    points, asked = (Rows.of(table).dense(width) for table in (train, test))
    labels = train.column("label").to_numpy()
    reach, floor, row = (test.column(name).to_numpy() for name in ("reach", "floor", "row"))
    none = np.zeros(0, np.int64)
    owners, places, found = [none], [none], [np.zeros(0)]
    sums = np.zeros((len(asked), 2))
    slack = _slack(asked, points)
    for some, held, far in _blocks(asked, reach, train, points):
        # Surely below the floor; what may lie between is measured exactly.
        below = far <= (floor[some] - slack)[:, None]
        sums[some, 0] += below.sum(axis=1)
        sums[some, 1] += below @ labels[held]
        i, j = np.nonzero((far <= (reach[some] + slack)[:, None]) & ~below)
        i, j = some[i], held[j]
        exact = _summed(asked[i] - points[j])
        near = np.flatnonzero(exact <= reach[i])
        if len(near) > k:
            near = near[_nearest(i[near], exact[near], j[near], k)]
        owners.append(i[near])
        places.append(j[near])
        found.append(exact[near])
    owner, place, exact = (np.concatenate(parts) for parts in (owners, places, found))
    # Of all cells of the region.
    order = _nearest(owner, exact, place, k)
    at = pa.array(place[order])
    singly = pa.table(
        [row[owner[order]], exact[order], train.column("key").take(at),
         train.column("label").take(at), np.ones(len(at), np.int64)],
        schema=schema,
    )
    some = np.flatnonzero(sums[:, 0])
    summed = pa.table(
        [row[some], np.full(len(some), -1.0), pa.nulls(len(some), schema.field("key").type),
         sums[some, 1], sums[some, 0].astype(np.int64)],
        schema=schema,
    )
    return pa.concat_tables([summed, singly])


def _visits(test: DataFrame, cells: Cells, width: int, k: int, home: bool) -> DataFrame:
    """Each test row with the regions it visits: that of its home, which is named, with a bound of
    its reach, or all whose box is within its reach."""
    tops, of_cell = cells.regions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = None if home else cells.boxes()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Rows.of(batch).dense(width)
            if home:
                to = cells.tree.cell_of(x)
                # A home with k rows bounds the reach by itself.
                small = cells.rows[to] < k
                reach = np.full(len(x), np.inf)
                reach[small] = [cells.enough(point, k) for point in x[small]]
                batch = batch.append_column("reach", pa.array(reach))
                batch = batch.append_column("cell", pa.array(to.astype(np.int32)))
                to = of_cell[to]
            else:
                at, to = cells.within(x, batch.column("reach").to_numpy(), boxes, tops)
                batch = batch.take(pa.array(at))
            yield batch.append_column("region", pa.array(to.astype(np.int32)))

    more = "reach double, cell int, region int" if home else "region int"
    return test.mapInArrow(run, f"{_kinds(test)}, {more}")


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def _answered(visits: DataFrame, located: DataFrame, answer, kind: str) -> DataFrame:
    """``answer`` of each visited region and the rows that visit it. A region that very many rows
    visit is answered in several tasks, each with a copy of the region."""
    spark = visits.sparkSession
    # Visits are made twice rather than written.
    counts = visits.groupBy("region").count().where(F.col("count") > REGION_VISITS).collect()
    # One row for each region at most.
    parts = spark.createDataFrame(
        [(row["region"], -(-row["count"] // REGION_VISITS)) for row in counts],
        "region int, parts bigint",
    )

    def dealt(df: DataFrame) -> DataFrame:
        known = df.join(F.broadcast(parts), "region", "left")
        return known.withColumn("parts", F.coalesce("parts", F.lit(1)))

    one = F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    left = dealt(visits).select(*visits.columns, one)
    right = dealt(located).select(*located.columns, every)
    by = ["region", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(answer, kind)


def _bounded(asked: DataFrame, cells: Cells, located: DataFrame, width: int, k: int) -> DataFrame:
    """``asked`` with ``reach``, within which lie at least ``k`` rows (or all, if there are fewer)
    and few more, and ``floor``, within which lie fewer than ``k``.

    The home of a test row gives a first reach. Rows within it are counted by steps of it, over all
    cells: the step with the k-th row has the two bounds, and is counted by finer steps in turn. What
    travels is a row of counts per region.
    """
    home = _answered(
        _visits(asked, cells, width, k, True), located,
        lambda test, train: _home_reach(test, train, width, k), "row bigint, reach double",
    )
    bounds = asked.join(home, "row").withColumn("floor", F.lit(-1.0))
    bounds = stage(bounds, "neighbour-reach")
    columns, done = bounds.columns, []
    for _ in range(COUNTINGS):
        found = _narrowed(bounds, cells, located, width, k)
        done.append(found.where(F.col("between") <= FEW).select(columns))
        bounds = found.where(F.col("between") > FEW).select(columns)
        if bounds.isEmpty():
            break
    return reduce(DataFrame.unionByName, done, bounds)


def _narrowed(bounds: DataFrame, cells: Cells, located: DataFrame, width: int, k: int) -> DataFrame:
    """``bounds`` with a closer ``reach`` and ``floor``, by one counting, and how many rows lie
    ``between`` them."""
    visited = _answered(
        _visits(bounds, cells, width, k, False), located,
        lambda test, train: _counted(test, train, width),
        f"row bigint, {', '.join(f'{name} int' for name in COUNTS)}",
    )
    boxed = cells.rows > 0
    wide = _slack(cells.low[boxed], cells.high[boxed])
    counts = visited.groupBy("row").agg(*(F.sum(name).alias(name) for name in COUNTS))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            room = 2 * max(_slack(Rows.of(batch).dense(width), np.zeros((0, width))), wide)
            reach, floor = (batch.column(name).to_numpy() for name in ("reach", "floor"))
            within = np.cumsum([batch.column(name).to_numpy() for name in COUNTS], axis=0).T
            steps = np.column_stack([np.full(len(reach), -1.0), _steps(reach, floor, width)])
            # Fewer rows than k in all: each is near.
            at = np.where(within[:, -1] >= k, (within < k).sum(axis=1), STEPS - 1)
            lines = np.arange(len(reach))
            # Counts may be one step off for rows at its very end: both bounds give way to them.
            high = np.where(np.isinf(reach), np.inf, np.minimum(steps[lines, at + 1] + room, reach))
            low = np.where(np.isinf(reach), -1.0, steps[lines, at] - room)
            # Without k rows in any reach there is nothing to narrow.
            between = np.where(np.isinf(reach), 0, np.diff(within, axis=1, prepend=0)[lines, at])
            known = batch.select(["row", "indices", "values"])
            yield pa.RecordBatch.from_arrays(
                [*known.columns, pa.array(high), pa.array(low), pa.array(between)],
                names=[*known.schema.names, "reach", "floor", "between"],
            )

    named = bounds.select("row", "indices", "values", "reach", "floor")
    kinds = f"{_kinds(named)}, between bigint"
    return stage(named.join(counts, "row").mapInArrow(bound, kinds), "neighbour-bounds")


def _found(
    train: DataFrame, test: DataFrame, k: int, cell_rows: int, each: bool
) -> DataFrame:
    """``row, distance, key, label, n`` of rows that hold the ``k`` nearest of every row of ``test``,
    no less; without ``each`` most are summed, at distance -1.

    Of training rows with equal vectors only the ``k`` with the smallest keys can be among the
    nearest. Only those are kept, which every task does before it shuffles, so a point that holds a
    third of all rows is as small as any other. Both inputs are read a few times and staged here.
    """
    width = width_of(train, FEATURES)
    if not width:
        raise ValueError("no training rows")
    rows = train.select(
        F.col(KEY).alias("key"), F.col(LABEL).cast("double").alias("label"), *entries(FEATURES)
    )
    equal = Window.partitionBy("indices", "values").orderBy("key", "label")
    kept = rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k)
    kept = stage(as_bytes(kept.select("key", "label", "indices", "values")), "neighbour-points")
    cells, located = grow(kept, width, cell_rows)
    located = stage(_regional(located, cells.regions()[1]), "neighbour-cells")
    asked = stage(as_bytes(test.select("row", "indices", "values")), "neighbour-asked")
    bounds = _bounded(asked, cells, located, width, k)
    if each:
        bounds = bounds.withColumn("floor", F.lit(-1.0))
    key_type = located.schema["key"].dataType.simpleString()
    return _answered(
        _visits(bounds, cells, width, k, False), located,
        lambda test, train: _search(test, train, width, k),
        f"row bigint, distance double, key {key_type}, label double, n bigint",
    )


def _by_distance() -> WindowSpec:
    return Window.partitionBy("row").orderBy("distance", "key", "label")


def nearest(
    train: DataFrame, test: DataFrame, k: int = 200, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``row, place, distance, key, label``: the ``k`` training rows nearest to every row of
    ``test`` (``row`` and a vector), by squared distance, ties to the smaller key."""
    known = test.where(F.col(FEATURES).isNotNull()).select("row", *entries(FEATURES))
    asked = stage(known.select("row", "indices", "values"), "neighbour-test")
    found = _found(train, asked, k, cell_rows, True).drop("n")
    return found.withColumn("place", F.row_number().over(_by_distance())).where(F.col("place") <= k)


def nearest_mean(
    train: DataFrame,
    test: DataFrame,
    name: str,
    k: int = 200,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``test`` with ``predictions_<name>``, the mean label of the ``k`` nearest training rows (of
    all, if there are fewer). Every row is kept; one without a vector has no prediction.

    Equal vectors have equal neighbours and are asked for once. Rows that are surely among the
    nearest are summed per region, only those around the k-th distance travel one by one.
    """
    rows = stage(test, "neighbour-rows")
    known = rows.where(F.col(FEATURES).isNotNull()).select(*entries(FEATURES))
    vectors = known.select("indices", "values").distinct()
    # A vector's number holds once it is written.
    asked = stage(vectors.withColumn("row", F.monotonically_increasing_id()), "neighbour-test")
    found = _found(train, asked, k, cell_rows, False)
    # The summed rows come first; they are fewer than k.
    before = _by_distance().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = found.withColumn("taken", F.sum("n").over(before)).where(F.col("taken") <= k)
    column = f"predictions_{name}"
    means = first.groupBy("row").agg((F.sum("label") / F.sum("n")).alias(column))
    answers = stage(asked.join(means, "row").select("indices", "values", column), "neighbour-means")
    parts = F.unwrap_udt(FEATURES)
    same = parts["indices"].eqNullSafe(answers["indices"]) & (parts["values"] == answers["values"])
    return rows.join(answers, same, "left").select(*(rows[c] for c in test.columns), column)
