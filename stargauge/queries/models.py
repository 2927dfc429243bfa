"""Model fits, validation and prediction."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators import models as ops
from stargauge.operators.features import QUANT_FEATURES, one_hot
from stargauge.operators.joins import join_business
from stargauge.operators.neighbours import nearest_mean
from stargauge.operators.subsets import subset
from stargauge.plans.modelling import model_frames, train_and_score
from stargauge.queries.base_sql import held_out, least_squares
from stargauge.queries.columns import r6
from stargauge.queries.registry import query
from stargauge.queries.subsets import _1_5, _5_8, _NAMES_1, _RATED
from stargauge.sources.warehouse import Warehouse

c = F.col
_NUMBERS = ", ".join(QUANT_FEATURES)


def _rows(train: str, test: str) -> str:
    return f"""SELECT review_id, rev_stars, {_NUMBERS}, TRUE AS fit, 0 AS fold FROM {train}
               UNION ALL SELECT review_id, NULL, {_NUMBERS}, FALSE, 0 FROM {test}"""


_PREDICTED = "SELECT review_id, round(predicted, 4) AS prediction FROM fitted WHERE NOT fit"


def _fit_sql(train: str, test: str) -> str:
    fitted = least_squares(_rows(train, test), QUANT_FEATURES, "rev_stars", "fold")
    return f"{fitted} {_PREDICTED}"


def _shown(df: DataFrame, name: str) -> DataFrame:
    return df.select("review_id", F.round(f"predictions_{name}", 4).alias("prediction"))


@query("m6_least_squares", _fit_sql("v_train_set", "v_test_set"))
def least_squares_fit(w: Warehouse) -> DataFrame:
    scored, _ = train_and_score(w.sets.train, w.sets.test, ops.least_squares(), "LinReg")
    return _shown(scored, "LinReg")


def _both(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    return model_frames(w.sets.train, w.sets.test)


@query("m7_ridge")
def ridge(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    return _shown(ops.fit_predict(train, test, ops.ridge(train), "Ridge")[0], "Ridge")


@query("m7_lasso")
def lasso(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    return _shown(ops.fit_predict(train, test, ops.lasso(0.01), "Lasso")[0], "Lasso")


@query("m7_elastic_net")
def elastic_net(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    scored, _ = ops.fit_predict(train, test, ops.elastic_net(train, 0.01), "ElasticNet")
    return _shown(scored, "ElasticNet")


@query("m8_lasso_cv")
def lasso_cv(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    estimator = ops.lasso_cv()
    return _shown(ops.fit_predict(train, test, estimator, "LassoCV")[0], "LassoCV")


@query("m9_forest")
def forest(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    return _shown(ops.fit_predict(train, test, ops.forest(), "RFReg_50")[0], "RFReg_50")


@query("m10_forest_classifier")
def forest_classifier(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    return _shown(ops.fit_predict(train, test, ops.forest_classifier(), "RFCls")[0], "RFCls")


@query("m10_boosted_trees")
def boosted_trees(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    return _shown(ops.fit_predict(train, test, ops.boosted_trees(), "GBT")[0], "GBT")


@query("m11_gradient_linear")
def gradient_linear(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    return _shown(ops.fit_predict(train, test, ops.gradient_linear(train), "SGD")[0], "SGD")


@query(
    "m11_univariate_line",
    """SELECT round(regr_slope(useful, bus_review_count), 6) AS slope,
              round(regr_intercept(useful, bus_review_count), 6) AS intercept,
              CAST(regr_count(useful, bus_review_count) AS BIGINT) AS n
       FROM v_train_reviews JOIN v_train_business USING (business_id)""",
)
def univariate(w: Warehouse) -> DataFrame:
    rows = join_business(w.train.review, w.train.business).select(
        c("rev_votes.useful").alias("useful"), "bus_review_count"
    )
    line = ops.univariate_line(rows, "bus_review_count", "useful")
    return line.select(r6("slope"), r6("intercept"), "n")


_ONE = "user_average_stars"


def _one_feature_sql(slope: str, places: int = 6) -> str:
    """Predictions of a penalised fit on one scaled feature, from its closed form.

    ``g`` is the covariance of the scaled feature with the label, ``n`` the number of rows.
    """
    return f"""
        WITH k AS (SELECT avg({_ONE}) AS m, stddev_pop({_ONE}) AS s, avg(rev_stars) AS level,
                          covar_pop({_ONE}, rev_stars) / stddev_pop({_ONE}) AS g, count(*) AS n
                   FROM v_train_set)
        SELECT review_id, round(level + ({slope}) * ({_ONE} - m) / s, {places}) AS prediction
        FROM v_test_set CROSS JOIN k"""


def _one_feature(w: Warehouse, make, places: int = 6) -> DataFrame:
    train, test = model_frames(w.sets.train, w.sets.test, [_ONE])
    scored, _ = ops.fit_predict(train, test, make(train), "One")
    return scored.select("review_id", F.round("predictions_One", places).alias("prediction"))


@query("m7_ridge_one_feature", _one_feature_sql("n * g / (n + 5000)"))
def ridge_one(w: Warehouse) -> DataFrame:
    return _one_feature(w, lambda train: ops.ridge(train, 5000.0))


@query("m7_lasso_one_feature", _one_feature_sql("sign(g) * greatest(abs(g) - 0.0005, 0)"))
def lasso_one(w: Warehouse) -> DataFrame:
    return _one_feature(w, lambda train: ops.lasso(0.0005))


@query(
    "m7_elastic_net_one_feature",
    _one_feature_sql("sign(g) * greatest(abs(g) - 0.0005, 0) / (1 + 0.4995)"),
)
def elastic_net_one(w: Warehouse) -> DataFrame:
    return _one_feature(w, lambda train: ops.elastic_net(train, 0.5, 0.001))


@query("m11_gradient_one_feature", _one_feature_sql("g / (1 + 0.5)", places=4))
def gradient_one(w: Warehouse) -> DataFrame:
    return _one_feature(w, lambda train: ops.gradient_linear(train, 0.5), places=4)


_CV_ROWS = f"""
    SELECT fold, review_id, rev_stars, {_NUMBERS}, NOT ({held_out("fold", 0.2)}) AS fit
    FROM v_train_set CROSS JOIN (SELECT unnest(range(10)) AS fold)
    WHERE {_5_8}"""


@query(
    "m13_cross_validation",
    least_squares(_CV_ROWS, QUANT_FEATURES, "rev_stars", "fold")
    + """ SELECT CAST(fold AS INT) AS fold, count(*) AS n,
                 round(sqrt(avg(pow(rev_stars - predicted, 2))), 6) AS rmse
          FROM fitted WHERE NOT fit GROUP BY fold""",
)
def cross_validation(w: Warehouse) -> DataFrame:
    train = subset(w.subset_sources, "all_5_8_train")
    frame, _ = model_frames(train, train)
    scores = ops.cross_validate(frame, ops.least_squares(), folds=10, share=0.2)
    return scores.select("fold", "n", r6("rmse"))


@query("m15_fit_and_predict", _fit_sql("v_train_set", "v_test_set"))
def fit_and_predict(w: Warehouse) -> DataFrame:
    train, test = _both(w)
    scored, _ = ops.fit_predict(train, test, ops.least_squares(), "LinReg")
    return _shown(scored, "LinReg")


@query(
    "m16_subset_to_subset",
    _fit_sql(
        f"(SELECT * FROM v_train_set WHERE {_5_8})", f"(SELECT * FROM v_test_set WHERE {_1_5})"
    ),
)
def subset_to_subset(w: Warehouse) -> DataFrame:
    train = subset(w.subset_sources, "all_5_8_train")
    test = subset(w.subset_sources, "all_1_5_test")
    scored, _ = train_and_score(train, test, ops.least_squares(), "LinReg")
    return _shown(scored, "LinReg")


def fit_numbers_sql(train: str, test: str, numbers: list[str]) -> str:
    listed = ", ".join(numbers)
    rows = f"""SELECT review_id, rev_stars, {listed}, TRUE AS fit, 0 AS fold FROM {train}
               UNION ALL SELECT review_id, NULL, {listed}, FALSE, 0 FROM {test}"""
    return f"{least_squares(rows, numbers, 'rev_stars', 'fold')} {_PREDICTED}"


def _by_subset(w: Warehouse, train: str, test: str, numbers: list[str]) -> DataFrame:
    scored, _ = train_and_score(
        subset(w.subset_sources, train), subset(w.subset_sources, test), ops.least_squares(),
        "LinReg", numbers,
    )
    return _shown(scored, "LinReg")


# Cold-start subsets are predicted from what their rows have.
NAME_NUMBERS = ["bus_review_count", "calc_total_checkins", "bus_name_avg"]
_USER_NUMBERS = ["user_average_stars", "user_review_count", "calc_total_checkins"]
_BUSINESS_NUMBERS = ["bus_stars", "bus_review_count", "calc_total_checkins"]


@query(
    "m15_names_1",
    fit_numbers_sql(
        "(SELECT * FROM v_train_set WHERE bus_name_counts = 2)",
        f"(SELECT * FROM v_master_set WHERE {_NAMES_1})",
        NAME_NUMBERS,
    ),
)
def names_1(w: Warehouse) -> DataFrame:
    return _by_subset(w, "names_1_train", "names_1_test", NAME_NUMBERS)


@query(
    "m15_user_5",
    fit_numbers_sql(
        "(SELECT * FROM v_train_set WHERE user_review_count >= 5)",
        f"(SELECT * FROM v_master_set WHERE {_RATED} AND bus_stars IS NULL)",
        _USER_NUMBERS,
    ),
)
def user_5(w: Warehouse) -> DataFrame:
    return _by_subset(w, "user_5_train", "user_5_test", _USER_NUMBERS)


@query(
    "m15_business_5",
    fit_numbers_sql(
        "(SELECT * FROM v_train_set WHERE bus_review_count >= 5)",
        "(SELECT * FROM v_master_set WHERE bus_review_count >= 5"
        " AND user_average_stars IS NULL AND bus_stars > 0)",
        _BUSINESS_NUMBERS,
    ),
)
def business_5(w: Warehouse) -> DataFrame:
    return _by_subset(w, "business_5_train", "business_5_test", _BUSINESS_NUMBERS)


@query(
    "m15_with_open_flag",
    fit_numbers_sql(
        "(SELECT * EXCLUDE (bus_open), CAST(bus_open AS INT) AS bus_open FROM v_train_set)",
        "(SELECT * EXCLUDE (bus_open), CAST(bus_open AS INT) AS bus_open FROM v_test_set)",
        [*QUANT_FEATURES, "bus_open"],
    ),
)
def with_open_flag(w: Warehouse) -> DataFrame:
    scored, _ = train_and_score(
        w.sets.train, w.sets.test, ops.least_squares(), "LinReg", extra=["bus_open"]
    )
    return _shown(scored, "LinReg")


@query("m17_forward_selection")
def forward_selection(w: Warehouse) -> DataFrame:
    train = subset(w.subset_sources, "all_5_8_train")
    steps = ops.forward_selection(train, QUANT_FEATURES)
    return steps.select("step", "feature", r6("mean_rmse"))


_CUT = "bus_stars"


def _stump_sql(gain: str, left: str, right: str) -> str:
    """Predictions of one split on ``bus_stars``: at the midpoint of two neighbouring values with
    the highest gain, the lowest of equals."""
    return f"""
        WITH seen AS (SELECT {_CUT} AS x, rev_stars AS y FROM v_train_set),
        cuts AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS cut
                 FROM (SELECT DISTINCT x FROM seen)),
        sides AS (SELECT cut, x <= cut AS low, y FROM seen CROSS JOIN cuts WHERE cut IS NOT NULL),
        gains AS ({gain}),
        best AS (SELECT cut FROM gains ORDER BY round(gain, 9) DESC, cut LIMIT 1),
        values AS (SELECT (SELECT {left} FROM seen WHERE x <= cut) AS low,
                          (SELECT {right} FROM seen WHERE x > cut) AS high, cut FROM best)
        SELECT review_id, CAST(CASE WHEN {_CUT} <= cut THEN low ELSE high END AS DOUBLE)
            AS prediction
        FROM v_test_set CROSS JOIN values"""


_VARIANCE_GAIN = """SELECT cut, sum(total * total / n) AS gain FROM
    (SELECT cut, low, count(*) AS n, CAST(sum(y) AS DOUBLE) AS total FROM sides GROUP BY cut, low)
    GROUP BY cut"""
_GINI_GAIN = """SELECT cut, sum(squares / n) AS gain FROM
    (SELECT cut, low, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS squares
     FROM (SELECT cut, low, y, count(*) AS n FROM sides GROUP BY cut, low, y) GROUP BY cut, low)
    GROUP BY cut"""
_MEAN = "round(avg(y), 6)"
_COMMONEST = "mode(y ORDER BY y)"


def _stump(w: Warehouse, estimator) -> DataFrame:
    train, test = model_frames(w.sets.train, w.sets.test, [_CUT])
    scored, _ = ops.fit_predict(train, test, estimator, "Stump")
    return scored.select("review_id", r6("predictions_Stump").alias("prediction"))


@query("m9_forest_one_split", _stump_sql(_VARIANCE_GAIN, _MEAN, _MEAN))
def forest_one_split(w: Warehouse) -> DataFrame:
    return _stump(w, ops.forest(1, 1).setBootstrap(False))


@query("m10_classifier_one_split", _stump_sql(_GINI_GAIN, _COMMONEST, _COMMONEST))
def classifier_one_split(w: Warehouse) -> DataFrame:
    return _stump(w, ops.forest_classifier(1, 1).setBootstrap(False))


@query("m10_boosting_one_round", _stump_sql(_VARIANCE_GAIN, _MEAN, _MEAN))
def boosting_one_round(w: Warehouse) -> DataFrame:
    return _stump(w, ops.boosted_trees(1, 1))


def _first_step_sql() -> str:
    """The best single feature: a line per candidate and fold, judged on the rows held out."""
    return f"""
        WITH long AS (
            SELECT fold, review_id, CAST(rev_stars AS DOUBLE) AS y, {held_out("fold", 0.2)} AS out,
                   unnest([{", ".join(f"'{name}'" for name in QUANT_FEATURES)}]) AS feature,
                   unnest([{", ".join(f"CAST({name} AS DOUBLE)" for name in QUANT_FEATURES)}]) AS x
            FROM v_train_set CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold) WHERE {_5_8}),
        lines AS (SELECT fold, feature, regr_slope(y, x) AS slope, regr_intercept(y, x) AS level
                  FROM long WHERE NOT out GROUP BY fold, feature),
        scores AS (SELECT fold, feature, sqrt(avg(pow(y - level - slope * x, 2))) AS rmse
                   FROM long JOIN lines USING (fold, feature) WHERE out GROUP BY fold, feature)
        SELECT CAST(1 AS INT) AS step, feature, round(avg(rmse), 6) AS mean_rmse
        FROM scores GROUP BY feature ORDER BY avg(rmse) LIMIT 1"""


@query("m17_first_step", _first_step_sql())
def first_step(w: Warehouse) -> DataFrame:
    train = subset(w.subset_sources, "all_5_8_train")
    steps = ops.forward_selection(train, QUANT_FEATURES)
    return steps.where("step = 1").select("step", "feature", r6("mean_rmse"))


_FOLDS = 3
_FOLD_SQL = f"CAST(CAST('0x' || substr(md5(review_id), 1, 8) AS BIGINT) % {_FOLDS} AS INT)"


def _lasso_cv_sql() -> str:
    """Penalties of the grid on one scaled feature: the path has a closed form, and the error on
    the rows held out follows from their sums."""
    return f"""
        WITH k AS (SELECT avg({_ONE}) AS m, stddev_pop({_ONE}) AS s FROM v_train_set),
        seen AS (SELECT ({_ONE} - m) / s AS x, CAST(rev_stars AS DOUBLE) AS y, {_FOLD_SQL} AS fold
                 FROM v_train_set CROSS JOIN k),
        whole AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS g, var_pop(x) AS v
                  FROM seen),
        grid AS (SELECT i, abs(g) * pow(0.001, i / 99.0) AS penalty
                 FROM whole CROSS JOIN (SELECT unnest(range(100)) AS i)),
        fits AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS g, var_pop(x) AS v
                 FROM seen JOIN (SELECT unnest(range({_FOLDS})) AS fold) f ON seen.fold <> f.fold
                 GROUP BY f.fold),
        sums AS (SELECT fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx,
                        sum(x * y) AS xy, sum(y * y) AS yy FROM seen GROUP BY fold),
        lines AS (SELECT fold, i, penalty, sign(g) * greatest(abs(g) - penalty, 0) / v AS b, mx, my
                  FROM fits CROSS JOIN grid),
        errors AS (SELECT i, penalty, avg((yy - 2 * b * xy - 2 * a * sums.y + b * b * xx
                     + 2 * a * b * sums.x + n * a * a) / n) AS mse
                   FROM (SELECT *, my - b * mx AS a FROM lines) JOIN sums USING (fold)
                   GROUP BY i, penalty),
        best AS (SELECT penalty FROM errors ORDER BY mse, i LIMIT 1)
        SELECT review_id, round(my + sign(g) * greatest(abs(g) - penalty, 0) / v
                   * (({_ONE} - m) / s - mx), 5) AS prediction
        FROM v_test_set CROSS JOIN k CROSS JOIN whole CROSS JOIN best"""


@query("m8_lasso_cv_one_feature", _lasso_cv_sql())
def lasso_cv_one(w: Warehouse) -> DataFrame:
    train, test = model_frames(w.sets.train, w.sets.test, [_ONE])
    digits = F.conv(F.substring(F.md5("review_id"), 1, 8), 16, 10).cast("bigint")
    folded = train.withColumn("fold", (digits % _FOLDS).cast("int"))
    estimator = ops.lasso_cv(folds=_FOLDS, fold_column="fold")
    scored, _ = ops.fit_predict(folded, test, estimator, "One")
    return scored.select("review_id", F.round("predictions_One", 5).alias("prediction"))


def _subset_frames(w: Warehouse, **more) -> tuple[DataFrame, DataFrame]:
    sources = w.subset_sources
    return model_frames(subset(sources, "all_5_8_train"), subset(sources, "all_1_5_test"), **more)


_PLACES = 6


def _scaled_sql(rows: str) -> str:
    scaled = ", ".join(
        f"round(({name} - m_{i}) / s_{i}, {_PLACES}) AS x_{i}" for i, name in enumerate(QUANT_FEATURES)
    )
    return f"SELECT review_id, {scaled}, {{more}} FROM {rows} CROSS JOIN k"


def _neighbours_sql(k: int) -> str:
    """Mean stars of the nearest rows, by all distances. Squares are added in the order of the
    features."""
    moments = ", ".join(
        f"avg({name}) AS m_{i}, stddev_pop({name}) AS s_{i}" for i, name in enumerate(QUANT_FEATURES)
    )
    far = " + ".join(
        f"(te.x_{i} - tr.x_{i}) * (te.x_{i} - tr.x_{i})" for i in range(len(QUANT_FEATURES))
    )
    train = f"(SELECT * FROM v_train_set WHERE {_5_8})"
    test = f"(SELECT * FROM v_test_set WHERE {_1_5})"
    return f"""
        WITH k AS (SELECT {moments} FROM {train}),
        tr AS MATERIALIZED ({_scaled_sql(train).format(more="rev_stars")}),
        te AS MATERIALIZED ({_scaled_sql(test).format(more="0 AS none")}),
        near AS (SELECT te.review_id AS review_id, rev_stars, row_number() OVER (
                     PARTITION BY te.review_id ORDER BY {far}, tr.review_id) AS place
                 FROM te CROSS JOIN tr)
        SELECT review_id, round(avg(rev_stars), 6) AS prediction
        FROM near WHERE place <= {k} GROUP BY review_id"""


@query("m12_knn_200", _neighbours_sql(200))
def neighbours_200(w: Warehouse) -> DataFrame:
    train, test = _subset_frames(w, places=_PLACES)
    scored = nearest_mean(train, test, "KNN_200", k=200)
    return scored.select("review_id", r6("predictions_KNN_200").alias("prediction"))


@query(
    "m6_sparse_users",
    """SELECT review_id, round(coalesce(mean, (SELECT avg(rev_stars) FROM v_train_set)), 4)
           AS prediction
       FROM v_test_set LEFT JOIN (SELECT user_id, avg(rev_stars) AS mean FROM v_train_set
                                  GROUP BY user_id) USING (user_id)""",
)
def sparse_users(w: Warehouse) -> DataFrame:
    """One-hot vectors of all users: the fit is the mean of each."""
    train, test = one_hot(w.sets.train, [w.sets.train, w.sets.test], "user_id")
    train, test = (df.withColumnRenamed("user_id_vector", "features") for df in (train, test))
    scored, _ = ops.fit_predict(train, test, ops.sparse_least_squares(), "Sparse")
    return _shown(scored, "Sparse")


@query(
    "m6_zip_and_user_stars",
    f"""WITH around AS (
            SELECT bus_zip_code, avg({_ONE}) AS x, avg(rev_stars) AS y FROM v_train_set
            GROUP BY bus_zip_code),
        line AS (SELECT sum(({_ONE} - x) * (rev_stars - y)) / sum(pow({_ONE} - x, 2)) AS slope
                 FROM v_train_set JOIN around USING (bus_zip_code))
        SELECT review_id, round(y + slope * ({_ONE} - x), 4) AS prediction
        FROM v_test_set JOIN around USING (bus_zip_code) CROSS JOIN line""",
)
def zip_and_stars(w: Warehouse) -> DataFrame:
    """A slope within zip codes: one number and a one-hot vector, from raw rows."""
    scored, _ = train_and_score(
        w.sets.train, w.sets.test, ops.sparse_least_squares(), "Zip", [_ONE],
        categorical=["bus_zip_code"],
    )
    return _shown(scored, "Zip")


@query("m11_stochastic_gradient")
def stochastic_gradient(w: Warehouse) -> DataFrame:
    train, test = _subset_frames(w)
    return _shown(ops.fit_predict(train, test, ops.stochastic_gradient(), "SGD")[0], "SGD")


@query("m9_extra_trees")
def extra_trees(w: Warehouse) -> DataFrame:
    train, test = _subset_frames(w, keyed=False)
    return _shown(ops.fit_predict(train, test, ops.extra_trees(30), "ExtraTrees")[0], "ExtraTrees")


def _drawn_split_sql() -> str:
    """One split of one tree: a cut per feature, drawn by a hash between its bounds."""
    cuts = " UNION ALL ".join(
        f"""SELECT {i} AS k, min({name}) + (max({name}) - min({name}))
            * (CAST('0x' || substr(md5('0|0|0|{i}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS cut
            FROM seen"""
        for i, name in enumerate(QUANT_FEATURES)
    )
    long = " UNION ALL ".join(
        f"SELECT {i} AS k, {name} AS x, rev_stars AS y FROM seen"
        for i, name in enumerate(QUANT_FEATURES)
    )
    value = " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(QUANT_FEATURES))
    return f"""
        WITH seen AS (SELECT * FROM v_train_set WHERE {_5_8}),
        cuts AS ({cuts}), long AS ({long}),
        sides AS (SELECT k, cut, x > cut AS above, count(*) AS n, sum(y) AS total
                  FROM long JOIN cuts USING (k) GROUP BY k, cut, x > cut),
        best AS (SELECT k, cut FROM sides GROUP BY k, cut
                 ORDER BY round(sum(CAST(total AS DOUBLE) * total / n), 6) DESC, k LIMIT 1),
        leaves AS (SELECT above, total / n AS value FROM sides JOIN best USING (k, cut))
        SELECT review_id, round(value, 6) AS prediction
        FROM (SELECT review_id, CASE best.k {value} END > best.cut AS above
              FROM v_test_set CROSS JOIN best WHERE {_1_5}) JOIN leaves USING (above)"""


@query("m9_extra_tree_one_split", _drawn_split_sql())
def extra_tree_one_split(w: Warehouse) -> DataFrame:
    train, test = _subset_frames(w, keyed=False)
    scored, _ = ops.fit_predict(train, test, ops.extra_trees(1, 1), "Stump")
    return scored.select("review_id", r6("predictions_Stump").alias("prediction"))


@query("m11_support_vector")
def support_vector(w: Warehouse) -> DataFrame:
    train, test = _subset_frames(w)
    scored, _ = ops.fit_predict(train, test, ops.support_vector(0.01, 0.5), "SVR")
    return scored.select("review_id", F.round("predictions_SVR", 2).alias("prediction"))


def _selection_sql(steps: int) -> str:
    """Greedy choice among all sets of up to ``steps`` features: a fit per set and fold, with the
    features outside the set left out of it."""
    names = QUANT_FEATURES
    sets = [s for n in range(1, steps + 1) for s in combinations(range(len(names)), n)]
    listed = ", ".join(f"({i}, {[int(k in s) for k in range(len(names))]})" for i, s in enumerate(sets))
    columns = ", ".join(f"CASE WHEN used[{k + 1}] = 1 THEN {n} ELSE 0 END AS x_{k}" for k, n in enumerate(names))
    rows = f"""SELECT review_id, rev_stars, used, fold, number, fold * 1000 + number AS fit_number,
                      NOT ({held_out("fold", 0.2)}) AS fit, {columns}
               FROM v_train_set CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold)
               CROSS JOIN (VALUES {listed}) AS s(number, used) WHERE {_5_8}"""
    fits = least_squares(rows, [f"x_{k}" for k in range(len(names))], "rev_stars", "fit_number")
    # A feature outside the set is a constant zero, whose slope is undefined: it has none.
    fits = re.sub(r"covar_pop\((\w+), (\w+)\) / var_pop\(\2\)", r"coalesce(covar_pop(\1, \2) / nullif(var_pop(\2), 0), 0)", fits)
    chain = [
        "step_1 AS (SELECT 1 AS step, used, mean_rmse FROM scores WHERE list_sum(used) = 1"
        " ORDER BY mean_rmse LIMIT 1)"
    ] + [
        f"""step_{n} AS (SELECT {n} AS step, s.used, s.mean_rmse FROM scores s, step_{n - 1} p
            WHERE list_sum(s.used) = {n} AND list_dot_product(s.used, p.used) = {n - 1}
            ORDER BY s.mean_rmse LIMIT 1)"""
        for n in range(2, steps + 1)
    ]
    named = " ".join(f"WHEN {k + 1} THEN '{n}'" for k, n in enumerate(names))
    every = " UNION ALL ".join(
        [f"SELECT 1 AS step, list_position(used, 1) AS place, mean_rmse FROM step_1"]
        + [
            f"""SELECT {n} AS step, list_position(list_transform(range(1, {len(names) + 1}),
                lambda i: a.used[i] - b.used[i]), 1) AS place, a.mean_rmse
                FROM step_{n} a, step_{n - 1} b"""
            for n in range(2, steps + 1)
        ]
    )
    return f"""{fits},
        errors AS (SELECT used, fold, sqrt(avg(pow(rev_stars - predicted, 2))) AS rmse
                   FROM fitted WHERE NOT fit GROUP BY used, fold),
        scores AS (SELECT used, avg(rmse) AS mean_rmse FROM errors GROUP BY used),
        {", ".join(chain)}
        SELECT CAST(step AS INT) AS step, CASE place {named} END AS feature,
               round(mean_rmse, 6) AS mean_rmse FROM ({every})"""


@query("m17_three_steps", _selection_sql(3))
def three_steps(w: Warehouse) -> DataFrame:
    train = subset(w.subset_sources, "all_5_8_train")
    steps = ops.forward_selection(train, QUANT_FEATURES, least_steps=3)
    return steps.where("step <= 3").select("step", "feature", r6("mean_rmse"))
