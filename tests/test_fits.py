"""Fits of the library's own, against closed forms, plain NumPy versions and all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stargauge.operators import features as feats
from stargauge.operators import models as ops
from stargauge.operators import gradient_fits, neighbours, trees
from stargauge.operators.folded import fold_of, fold_sums, sweep
from stargauge.operators.neighbours import grow, nearest_mean
from stargauge.operators.trees import drawn
from stargauge.operators.vectors import Rows, as_bytes, entries, width_of

SCHEMA = "review_id string, rev_stars double, a double, b double, c double"
NAMES = ["a", "b", "c"]


def table(seed=3, n=400):
    noise = np.random.default_rng(seed)
    x = noise.normal(size=(n, 3))
    x[:, 1] += 0.5 * x[:, 0]
    y = 3 + 1.5 * x[:, 0] - 0.7 * x[:, 1] + 0.3 * noise.normal(size=n)
    return x, y


def frame(spark, x, y, partitions=3):
    data = [(str(i), float(y[i]), *map(float, x[i])) for i in range(len(y))]
    df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    return feats.assemble(df, NAMES)


def closed_form(x, y, l2=0.0):
    """``|y - xw|^2 / 2n + l2 |w|^2 / 2``."""
    around, n = x - x.mean(0), len(y)
    w = np.linalg.solve(around.T @ around / n + l2 * np.eye(x.shape[1]), around.T @ (y - y.mean()) / n)
    return w, y.mean() - x.mean(0) @ w


# ---- sparse least squares -----------------------------------------------------------------


def test_sparse_least_squares_equals_the_closed_form(spark):
    x, y = table()
    df = frame(spark, x, y)
    model = ops.sparse_least_squares().fit(df)
    w, b = closed_form(x, y)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-7)
    assert abs(model.intercept - b) < 1e-7
    ridge = ops.sparse_least_squares(40.0).fit(df)
    assert np.allclose(ridge.coefficients.toArray(), closed_form(x, y, 40.0 / len(y))[0], atol=1e-7)


def test_five_thousand_labels_are_their_means(spark):
    noise = np.random.default_rng(1)
    labels = noise.integers(0, 5000, 15000)
    y = noise.integers(1, 6, 15000).astype(float)
    rows = [(str(i), float(s), f"n{c}") for i, (c, s) in enumerate(zip(labels, y))]
    train = spark.createDataFrame(rows, "review_id string, rev_stars double, name string")
    test = spark.createDataFrame(
        [("x", 0.0, "unseen"), ("y", 0.0, None), ("z", 0.0, "n7")],
        "review_id string, rev_stars double, name string",
    )
    train, test = (
        df.withColumnRenamed("name_vector", "features")
        for df in feats.one_hot(train, [train, test], "name")
    )
    fitted = ops.sparse_least_squares()
    scored, model = ops.fit_predict(train, test, fitted, "S")
    found = {row["review_id"]: row["predictions_S"] for row in scored.collect()}
    assert model.numFeatures == len(set(labels)) > 4500
    assert fitted.passes_taken < 100
    # A row without an entry has the mean of all.
    assert abs(found["x"] - y.mean()) < 1e-6 and abs(found["y"] - y.mean()) < 1e-6
    assert abs(found["z"] - y[labels == 7].mean()) < 1e-6


# ---- sums of products ---------------------------------------------------------------------


def test_fold_sums_and_sweep(spark):
    x, y = table()
    df = frame(spark, x, y)
    sums = fold_sums(df, 3, fold_of(F.col("review_id"), 3))
    rows = np.column_stack([np.ones(len(y)), x, y])
    assert np.allclose(sums.whole, rows.T @ rows)
    assert np.allclose(sums.held.sum(axis=0), sums.whole)
    swept = sums.whole
    for k in range(4):
        swept = sweep(swept, k)
    w, b = closed_form(x, y)
    assert np.allclose(swept[:4, -1], [b, *w])
    # Sweeping is undone by sweeping again, up to the signs of its border.
    assert np.allclose(sweep(sweep(sums.whole, 1), 1)[1, 1], sums.whole[1, 1])


def lasso_path(x, y, penalties):
    n = len(y)
    around, target = x - x.mean(0), y - y.mean()
    gram, cross, w = around.T @ around / n, around.T @ target / n, np.zeros(x.shape[1])
    for penalty in penalties:
        for _ in range(2000):
            for k in range(len(w)):
                gap = cross[k] - gram[k] @ w + gram[k, k] * w[k]
                w[k] = np.sign(gap) * max(abs(gap) - penalty, 0) / gram[k, k]
        yield w.copy(), y.mean() - w @ x.mean(0)


def test_lasso_path_matches_plain_fits(spark):
    x, y = table(n=150)
    fold = np.arange(150) % 3
    data = [(str(i), float(y[i]), *map(float, x[i]), int(fold[i])) for i in range(150)]
    df = feats.assemble(spark.createDataFrame(data, SCHEMA + ", fold int"), NAMES)
    estimator = ops.lasso_cv(folds=3, penalties=12, fold_column="fold")
    model = estimator.fit(df)
    top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / 150
    grid = [top * 1e-3 ** (i / 11) for i in range(12)]
    errors = np.zeros((3, 12))
    for f in range(3):
        out = fold == f
        for i, (w, b) in enumerate(lasso_path(x[~out], y[~out], grid)):
            errors[f, i] = np.mean((y[out] - x[out] @ w - b) ** 2)
    best = int(errors.mean(axis=0).argmin())
    assert np.allclose(estimator.path.penalties, grid)
    assert np.allclose(estimator.path.errors, errors.mean(axis=0), atol=1e-9)
    assert estimator.path.best == best
    w, b = list(lasso_path(x, y, grid[: best + 1]))[-1]
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-8) and abs(model.intercept - b) < 1e-8


def test_one_scan_for_all_folds_and_penalties(spark):
    """Folds, penalties and steps start no job that reads the rows again."""
    x, y = table(n=60)
    df = frame(spark, x, y)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = df.select("review_id", "rev_stars", *NAMES).mapInArrow(counted, SCHEMA)
    fold_sums(feats.assemble(watched, NAMES), 10, fold_of(F.col("review_id"), 10))
    # Once for the width (a row of the first batch), once for the sums.
    assert read.value <= 2 * 60
    before = read.value
    ops.forward_selection(watched, NAMES, folds=3, least_steps=3).collect()
    assert read.value - before <= 2 * 60


def test_selection_goes_on_for_the_least_steps(spark):
    x, y = table()
    df = frame(spark, x, y).drop("features")
    history = ops.forward_selection(df, NAMES, least_steps=3).collect()
    assert [row["step"] for row in history] == [1, 2, 3]
    assert [row["feature"] for row in history][:2] == ["a", "b"]
    # The same choice, fit by fit.
    slow = ops.forward_selection(df, NAMES, lambda: ops.sparse_least_squares(), least_steps=3)
    for one, two in zip(history, slow.collect(), strict=True):
        assert one["feature"] == two["feature"] and abs(one["mean_rmse"] - two["mean_rmse"]) < 1e-6


def test_a_dependent_feature_adds_nothing(spark):
    x, y = table()
    x[:, 2] = 2 * x[:, 0] - 1
    df = frame(spark, x, y).drop("features")
    history = {r["feature"]: r["mean_rmse"] for r in ops.forward_selection(df, NAMES, least_steps=3).collect()}
    assert abs(min(history.values()) - history["c"]) < 1e-9 or "c" == next(iter(history))


# ---- stochastic gradient ------------------------------------------------------------------


def test_stochastic_gradient_nears_the_closed_form(spark):
    x, y = table(n=2000)
    model = ops.stochastic_gradient(0.01).fit(frame(spark, x, y))
    w, b = closed_form(x, y, 0.01)
    assert np.abs(model.coefficients.toArray() - w).max() < 0.02
    assert abs(model.intercept - b) < 0.02


def test_stochastic_gradient_repeats_for_any_partitioning(spark):
    x, y = table(n=500)
    fits = []
    for partitions in (1, 5):
        estimator = ops.StochasticGradient(epochs=4, rows_per_shard=100)
        model = estimator.fit(frame(spark, x, y, partitions))
        fits.append([*model.coefficients, model.intercept])
    assert np.allclose(*fits, rtol=0, atol=1e-12)


# ---- support vector regression ------------------------------------------------------------


@pytest.mark.parametrize("rows_per_shard", [65_536, 100])
def test_support_vector_proves_its_gap(spark, rows_per_shard):
    x, y = table(n=300)
    estimator = ops.SupportVector(0.05, 0.2, rows_per_shard=rows_per_shard)
    model = estimator.fit(frame(spark, x, y))
    assert estimator.gap_left <= 1e-3
    weights = np.r_[model.coefficients.toArray(), model.intercept]
    full = np.column_stack([x, np.ones(300)])

    def value(w):
        return w @ w / 2 + 0.05 * np.maximum(np.abs(y - full @ w) - 0.2, 0).sum()

    best = value(weights)
    noise = np.random.default_rng(0)
    for _ in range(300):
        assert value(weights + 0.05 * noise.normal(size=4)) >= best * (1 - 1e-3)


def test_support_vector_takes_as_many_passes_for_more_rows(spark):
    """Rounds of dual ascent grow with the shards; Newton steps know none."""
    x, y = table(n=4000)
    taken = []
    for n in (400, 4000):
        estimator = ops.SupportVector(0.01, 0.5, rows_per_shard=100)
        estimator.fit(frame(spark, x[:n], y[:n]))
        assert estimator.gap_left <= 1e-3
        taken.append(estimator.rounds_taken)
    assert max(taken) <= 25


def test_support_vector_ends_where_no_row_is_in_a_corner(spark):
    """Labels that the features say nothing of, and few different rows: sharp corners are empty."""
    noise = np.random.default_rng(0)
    x = np.column_stack([noise.integers(0, 3, 1000), noise.integers(0, 9, 1000) / 4, noise.integers(0, 2, 1000)])
    y = noise.integers(1, 6, 1000).astype(float)
    estimator = ops.SupportVector(20.0, 0.5)
    model = estimator.fit(frame(spark, x - 1.0, y))
    assert estimator.gap_left <= 1e-3 and estimator.rounds_taken <= 30
    weights = np.r_[model.coefficients.toArray(), model.intercept]
    full = np.column_stack([x - 1.0, np.ones(1000)])

    def value(w):
        return w @ w / 2 + 20 * np.maximum(np.abs(y - full @ w) - 0.5, 0).sum()

    for size in (0.02, 0.5):
        for moved in noise.normal(size=(300, 4)) * size:
            assert value(weights + moved) >= value(weights) * (1 - 1e-3)


def test_the_lowest_point_above_planes(spark):
    noise = np.random.default_rng(1)
    slopes, gains = noise.normal(size=(30, 2)), noise.normal(size=30)
    bound, at = gradient_fits._lowest(slopes, gains, 1e-9)
    grid = np.stack(np.meshgrid(*[np.linspace(-3, 3, 601)] * 2), -1).reshape(-1, 2)
    values = (grid**2).sum(axis=1) / 2 + (gains - grid @ slopes.T).max(axis=1)
    assert bound <= values.min() <= bound + 0.02
    assert np.abs(at - grid[values.argmin()]).max() < 0.05


def test_support_vector_reads_packed_rows(spark, monkeypatch):
    seen, pack = [], gradient_fits.packed

    def spy(*given):
        seen.append(pack(*given))
        return seen[-1]

    monkeypatch.setattr(gradient_fits, "packed", spy)
    x, y = table(n=900)
    ops.SupportVector(0.05, 0.2).fit(frame(spark, x, y, partitions=2))
    assert seen[0].count() < 20


def test_wide_and_narrow_support_vectors_agree(spark, monkeypatch):
    x, y = table(n=300)
    fits = []
    for width in (0, 512):
        monkeypatch.setattr(gradient_fits, "NEWTON_WIDTH", width)
        estimator = ops.SupportVector(0.05, 0.2)
        model = estimator.fit(frame(spark, x, y))
        assert estimator.gap_left <= 1e-3
        fits.append([*model.coefficients, model.intercept])
    # The gap bounds how far two such fits lie from each other.
    assert np.allclose(*fits, rtol=0, atol=0.2)


def test_support_vector_on_one_feature_by_brute_force(spark):
    x, y = table(n=120)
    df = spark.createDataFrame(
        [(str(i), float(y[i]), float(x[i, 0])) for i in range(120)],
        "review_id string, rev_stars double, a double",
    )
    estimator = ops.SupportVector(0.1, 0.3, gap=1e-6, rounds=400)
    model = estimator.fit(feats.assemble(df, ["a"]))

    def value(w, b):
        return (w * w + b * b) / 2 + 0.1 * np.maximum(np.abs(y - w * x[:, 0] - b) - 0.3, 0).sum()

    slopes, levels = np.linspace(-1, 3, 201), np.linspace(0, 5, 251)
    best = min(value(w, b) for w in slopes for b in levels)
    assert value(model.coefficients[0], model.intercept) <= best + 1e-4


# ---- extremely randomised trees -----------------------------------------------------------


def grown(x, y, tree, depth):
    """A plain recursion over levels with the same draws: ``{place: (feature, cut) or value}``."""
    nodes, level = {}, [(0, np.arange(len(y)))]
    following = 1
    for _ in range(depth):
        after = []
        for place, rows in level:
            part, labels = x[rows], y[rows]
            low, high = part.min(0), part.max(0)
            nodes[place] = labels.mean()
            if len(rows) < 2 or labels.var() * len(rows) <= 1e-12 * max((labels**2).sum(), 1):
                continue
            best = None
            for k in range(x.shape[1]):
                if high[k] > low[k]:
                    cut = low[k] + drawn(0, tree, place, k) * (high[k] - low[k])
                    cut = cut if cut < high[k] else low[k]
                    left = part[:, k] <= cut
                    gain = labels[left].sum() ** 2 / left.sum() + labels[~left].sum() ** 2 / (~left).sum()
                    if best is None or gain > best[0]:
                        best = gain, k, cut, left
            if best is None:
                continue
            _, k, cut, left = best
            nodes[place] = (k, cut, following)
            after += [(following, rows[left]), (following + 1, rows[~left])]
            following += 2
        level = after
    nodes |= {place: y[rows].mean() for place, rows in level}
    return nodes


def walk(nodes, row):
    place = 0
    while isinstance(nodes[place], tuple):
        k, cut, first = nodes[place]
        place = first + (row[k] > cut)
    return nodes[place]


def test_extra_trees_equal_a_plain_recursion(spark):
    x, y = table(n=200)
    x, y = np.round(x, 1), np.round(y)
    df = frame(spark, x, y, partitions=4)
    scored, _ = ops.fit_predict(df, df, ops.extra_trees(3, 4), "T")
    found = {int(row["review_id"]): row["predictions_T"] for row in scored.collect()}
    forest = [grown(x, y, tree, 4) for tree in range(3)]
    for i, row in enumerate(x):
        assert abs(found[i] - np.mean([walk(nodes, row) for nodes in forest])) < 1e-9


def test_extra_trees_fit_better_with_depth(spark):
    x, y = table(n=400)
    df = frame(spark, x, y)
    errors = []
    for depth in (1, 8):
        scored, _ = ops.fit_predict(df, df, ops.extra_trees(10, depth), "T")
        errors.append(scored.agg(F.avg(F.pow(F.col("rev_stars") - F.col("predictions_T"), F.lit(2)))).first()[0])
    assert errors[1] < errors[0] / 4


def spied(seen, run):
    def spy(rows, *more):
        seen.append(rows.count())
        return run(rows, *more)

    return spy


def test_extra_trees_read_packed_rows(spark, monkeypatch):
    """Vectors go to Python once; the passes over the levels read some dozen of them as one cell."""
    cells = []
    for name in ("_bounds", "_sums"):
        monkeypatch.setattr(trees, name, spied(cells, getattr(trees, name)))
    x, y = table(n=900)
    ops.extra_trees(2, 3).fit(frame(spark, x, y, partitions=2))
    assert len(cells) == 6
    assert max(cells) < 20


# ---- nearest neighbours -------------------------------------------------------------------


def by_all_distances(x, y, keys, point, k):
    far = np.zeros(len(x))
    for j in range(x.shape[1]):
        far += (point[j] - x[:, j]) * (point[j] - x[:, j])
    order = sorted(range(len(x)), key=lambda i: (far[i], keys[i]))[:k]
    return np.mean(y[order])


@pytest.mark.parametrize("k", [1, 7, 200])
def test_neighbours_equal_all_distances(spark, k):
    noise = np.random.default_rng(5)
    x, y = noise.normal(size=(1500, 3)).round(1), noise.integers(1, 6, 1500).astype(float)
    # A third of all rows at one point, more than any cell may hold.
    x[::3] = 0.5
    train = frame(spark, x, y)
    asked = np.concatenate([x[:30], noise.normal(size=(30, 3)) * 3])
    test = frame(spark, asked, np.zeros(60)).unionByName(
        spark.createDataFrame([("none", 0.0, 0.0, 0.0, 0.0)], SCHEMA).withColumn(
            "features", F.lit(None).cast(train.schema["features"].dataType)
        )
    )
    scored = nearest_mean(train, test, "K", k=k, cell_rows=50)
    found = {row["review_id"]: row["predictions_K"] for row in scored.collect()}
    assert scored.columns == [*test.columns, "predictions_K"]
    assert len(found) == 61 and found["none"] is None
    keys = [str(i) for i in range(1500)]
    for i, point in enumerate(asked):
        assert abs(found[str(i)] - by_all_distances(x, y, keys, point, k)) < 1e-12


def test_fewer_rows_than_neighbours(spark):
    train = spark.createDataFrame(
        [("a", 1.0, Vectors.dense([0.0, 1.0])), ("b", 4.0, Vectors.sparse(2, [1], [3.0]))],
        ["review_id", "rev_stars", "features"],
    )
    (row,) = nearest_mean(train, train.limit(1), "K", k=200).collect()
    assert row["predictions_K"] == 2.5


def test_cells_are_small_and_hold_every_row(spark):
    noise = np.random.default_rng(2)
    x = np.exp(3 * noise.normal(size=(4000, 3)))
    x[:1500, 1:] = 1.0
    df = frame(spark, x, np.ones(4000))
    width = width_of(df, "features")
    rows = df.select(F.col("review_id").alias("key"), F.col("rev_stars").alias("label"), *entries("features"))
    cells, located = grow(rows.drop("size"), width, 100)
    counts = {row["cell"]: row["count"] for row in located.groupBy("cell").count().collect()}
    assert sum(counts.values()) == 4000 and max(counts.values()) <= 100
    assert all(cells.rows[cell] == n for cell, n in counts.items())


def test_wide_vectors_are_not_widened(spark):
    df = spark.createDataFrame([("a", 1.0, Vectors.sparse(10**6, [5], [1.0]))], ["review_id", "rev_stars", "features"])
    assert width_of(df, "features") == 10**6
    with pytest.raises(ValueError, match="too many"):
        ops.cross_validate(df, ops.least_squares())


@pytest.mark.parametrize("k", [20, 100])
def test_few_rows_travel_to_a_mean(spark, k, monkeypatch):
    noise = np.random.default_rng(9)
    x, y = noise.normal(size=(3000, 3)), noise.integers(1, 6, 3000).astype(float)
    train, test = frame(spark, x, y), frame(spark, x[:200], np.zeros(200))
    sent, plain = [], neighbours._found

    def counted(*given):
        found = plain(*given)
        sent.append(found.count())
        return found

    monkeypatch.setattr(neighbours, "_found", counted)
    scored = neighbours.nearest_mean(train, test, "K", k=k, cell_rows=500)
    keys = [str(i) for i in range(3000)]
    found = {row["review_id"]: row["predictions_K"] for row in scored.collect()}
    for i in range(0, 200, 10):
        assert abs(found[str(i)] - by_all_distances(x, y, keys, x[i], k)) < 1e-12
    # Every one of the nearest rows would be 200 * k at least.
    assert sent[0] < 200 * k


@pytest.mark.parametrize("k", [5, 60])
def test_a_row_travels_once_to_a_region(spark, k, monkeypatch):
    """Cells side by side answer together, and what is sent are a few rows around the k-th."""
    monkeypatch.setattr(neighbours, "REGIONS", 4)
    monkeypatch.setattr(neighbours, "FEW", 1)
    noise = np.random.default_rng(11)
    x, y = noise.normal(size=(3000, 3)).round(2), noise.integers(1, 6, 3000).astype(float)
    train, test = frame(spark, x, y), frame(spark, x[:200], np.zeros(200))
    sent, visits = [], []
    find, visit = neighbours._found, neighbours._visits
    monkeypatch.setattr(neighbours, "_found", lambda *given: sent.append(find(*given)) or sent[-1])
    monkeypatch.setattr(neighbours, "_visits", lambda *given: visits.append(visit(*given)) or visits[-1])
    scored = neighbours.nearest_mean(train, test, "K", k=k, cell_rows=60)
    keys = [str(i) for i in range(3000)]
    found = {row["review_id"]: row["predictions_K"] for row in scored.collect()}
    for i in range(200):
        assert abs(found[str(i)] - by_all_distances(x, y, keys, x[i], k)) < 1e-12
    for made in visits:
        assert made.count() == made.select("row", "region").distinct().count() <= 200 * 8
    # One row for each region, and few more.
    assert sent[0].where("key IS NOT NULL").count() < 200 * 4


def test_rows_close_together_are_counted_until_few_are_left(spark, monkeypatch):
    """The k-th row lies in a clump whose rows are almost equally far."""
    noise = np.random.default_rng(12)
    centres = noise.normal(size=(40, 3))
    x = np.repeat(centres, 100, axis=0) + 1e-4 * noise.normal(size=(4000, 3))
    y = noise.integers(1, 6, 4000).astype(float)
    sent, find = [], neighbours._found
    monkeypatch.setattr(neighbours, "_found", lambda *given: sent.append(find(*given)) or sent[-1])
    test = frame(spark, centres, np.zeros(40))
    scored = neighbours.nearest_mean(frame(spark, x, y), test, "K", k=150, cell_rows=300)
    found = {row["review_id"]: row["predictions_K"] for row in scored.collect()}
    keys = [str(i) for i in range(4000)]
    for i, point in enumerate(centres):
        assert abs(found[str(i)] - by_all_distances(x, y, keys, point, 150)) < 1e-12
    # The clump would be a hundred for each.
    assert sent[0].where("key IS NOT NULL").count() <= 40 * neighbours.FEW


def test_regions_are_cells_side_by_side(spark):
    x = np.random.default_rng(3).normal(size=(4000, 3))
    rows = frame(spark, x, np.ones(4000)).select(
        F.col("review_id").alias("key"), F.col("rev_stars").alias("label"), *entries("features")
    )
    cells, _ = grow(as_bytes(rows.drop("size")), 3, 20)
    tops, of_cell = cells.regions()
    held = np.bincount(of_cell, cells.rows)
    assert len(held) >= neighbours.REGIONS and held.sum() == 4000
    assert max(held) <= 4000 // neighbours.REGIONS and len(held) < len(cells.rows) / 2
    assert sorted(tops[tops >= 0]) == list(range(len(held)))
    # A row is near all regions if its reach is, and near that of its cell at least.
    every, regions = cells.within(x[:5], np.full(5, np.inf), cells.boxes(), tops)
    assert len(every) == 5 * len(held)
    own, regions = cells.within(x, np.zeros(4000), cells.boxes(), tops)
    assert set(zip(range(4000), of_cell[cells.tree.cell_of(x)])) <= set(zip(own, regions))


def test_vectors_as_bytes_are_the_same_rows(spark):
    vectors = [Vectors.dense([1.0, 0.0, -2.5]), Vectors.sparse(3, [2], [4.0]), Vectors.sparse(3, [], [])] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["n", "features"]).coalesce(1)
    listed = df.select("n", *entries("features")).drop("size")
    for made in (listed, as_bytes(listed)):
        table = made.orderBy("n").toArrow()
        for part in (table, table.slice(4, 7)):
            x = Rows.of(part).dense(3)
            expected = [vectors[i].toArray() for i in part.column("n").to_pylist()]
            assert np.array_equal(x, expected)
    assert as_bytes(listed).schema["values"].dataType.simpleString() == "binary"


def test_equal_test_rows_keep_their_own_answer(spark):
    x = np.random.default_rng(4).normal(size=(300, 3))
    y = np.arange(300) % 5 + 1.0
    asked = np.concatenate([x[:5]] * 8)
    test = frame(spark, asked, np.zeros(40))
    found = nearest_mean(frame(spark, x, y), test, "K", k=9, cell_rows=40).collect()
    keys = [str(i) for i in range(300)]
    assert len(found) == 40
    for row in found:
        expected = by_all_distances(x, y, keys, asked[int(row["review_id"])], 9)
        assert abs(row["predictions_K"] - expected) < 1e-12
