"""Baseline predictors and their cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.operators import benchmarks as ops
from stargauge.operators.cleaning import mean_of
from stargauge.operators.joins import join_business, join_user
from stargauge.operators.models import (
    benchmark_predictions,
    cross_validate_benchmark,
    cross_validate_training_mean,
)
from stargauge.queries.base_sql import held_out
from stargauge.queries.columns import r6
from stargauge.queries.registry import query
from stargauge.sources.warehouse import Warehouse

c = F.col

_KNOWN = """v_test_reviews LEFT JOIN v_train_business USING (business_id)
            LEFT JOIN v_train_user USING (user_id)"""
_FALLBACK = """CASE WHEN bus_stars > 0 THEN bus_stars
                    WHEN user_average_stars > 0 THEN user_average_stars
                    ELSE (SELECT mean FROM v_global) END"""


def _shown(df: DataFrame, name: str) -> DataFrame:
    return df.select("review_id", r6(f"benchmark_{name}"))


@query(
    "b1_business_mean",
    f"""SELECT review_id, round(coalesce(bus_stars, (SELECT mean FROM v_global)), 6)
        AS benchmark_bus_mean FROM {_KNOWN}""",
)
def business_mean(w: Warehouse) -> DataFrame:
    return _shown(ops.business_mean(w.test.review, w.train), "bus_mean")


@query(
    "b2_user_mean",
    f"""SELECT review_id, round(coalesce(user_average_stars, (SELECT mean FROM v_global)), 6)
        AS benchmark_usr_mean FROM {_KNOWN}""",
)
def user_mean(w: Warehouse) -> DataFrame:
    return _shown(ops.user_mean(w.test.review, w.train), "usr_mean")


@query(
    "b3_business_user_mean",
    f"SELECT review_id, round({_FALLBACK}, 6) AS benchmark_bus_usr_mean FROM {_KNOWN}",
)
def business_user_mean(w: Warehouse) -> DataFrame:
    return _shown(ops.business_user_mean(w.test.review, w.train), "bus_usr_mean")


@query(
    "b4_greater_count_mean",
    f"""SELECT review_id, round(CASE
          WHEN bus_review_count >= user_review_count AND bus_stars > 0 THEN bus_stars
          WHEN bus_review_count < user_review_count AND user_average_stars > 0
            THEN user_average_stars
          ELSE {_FALLBACK} END, 6) AS benchmark_grtr_rev_count_mean FROM {_KNOWN}""",
)
def greater_count_mean(w: Warehouse) -> DataFrame:
    return _shown(ops.greater_count_mean(w.test.review, w.train), "grtr_rev_count_mean")


@query(
    "b5_constant",
    "SELECT review_id, CAST(3.5 AS DOUBLE) AS benchmark_constant FROM v_test_reviews",
)
def constant(w: Warehouse) -> DataFrame:
    return _shown(ops.constant(w.test.review), "constant")


def _shrinkage_sql(users: str, by: str = "") -> str:
    """Common mean and pull of groups of users from their n, total and squares."""
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {by + "," if by else ""} level, CASE WHEN spread > 0 THEN within / spread END AS pull
        FROM (SELECT *, (between / nullif(users - 1, 0) - within) / size AS spread FROM (
            SELECT {by + "," if by else ""} sum(total) / sum(n) AS level, count(*) AS users,
                   sum(total * total / n) - sum(total) * sum(total) / sum(n) AS between,
                   (sum(squares) - sum(total * total / n)) / nullif(sum(n) - count(*), 0) AS within,
                   (sum(n) - sum(n * n) / sum(n)) / nullif(count(*) - 1, 0) AS size
            FROM {users} {group}))"""


_SUMS = """CAST(count(*) AS DOUBLE) AS n, CAST(sum(rev_stars) AS DOUBLE) AS total,
           CAST(sum(rev_stars * rev_stars) AS DOUBLE) AS squares"""


@query(
    "b7_weighted_user_mean",
    f"""WITH users AS (SELECT user_id, {_SUMS} FROM v_train_reviews GROUP BY user_id),
        parts AS ({_shrinkage_sql("users")})
        SELECT review_id, round(coalesce(
            (coalesce(total, 0) + pull * level) / (coalesce(n, 0) + pull), level), 6)
            AS benchmark_usr_wtd_mean
        FROM v_test_reviews LEFT JOIN users USING (user_id) CROSS JOIN parts""",
)
def weighted_user_mean(w: Warehouse) -> DataFrame:
    return _shown(ops.weighted_user_mean(w.test.review, w.train), "usr_wtd_mean")


@query(
    "m14_cv_weighted_user_mean",
    f"""WITH marked AS (
            SELECT fold, user_id, rev_stars, {held_out("fold", 0.15)} AS held
            FROM v_train_reviews CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold)),
        users AS (SELECT fold, user_id, {_SUMS} FROM marked WHERE NOT held
                  GROUP BY fold, user_id),
        parts AS ({_shrinkage_sql("users", "fold")})
        SELECT CAST(fold AS INT) AS fold, count(*) AS n,
               round(sqrt(avg(pow(rev_stars - coalesce((coalesce(total, 0) + pull * level)
                   / (coalesce(n, 0) + pull), level), 2))), 6) AS rmse
        FROM marked LEFT JOIN users USING (fold, user_id) JOIN parts USING (fold)
        WHERE held GROUP BY fold""",
)
def cv_weighted_user_mean(w: Warehouse) -> DataFrame:
    scores = ops.cross_validate_weighted_user_mean(w.train.review, folds=3, share=0.15)
    return scores.select("fold", "n", r6("rmse"))


def _by_business(w: Warehouse) -> DataFrame:
    return join_business(w.train.review, w.train.business.select("business_id", "bus_stars"))


def _by_user(w: Warehouse) -> DataFrame:
    return join_user(w.train.review, w.train.user.select("user_id", "user_average_stars"))


def _folds(prediction: str, rows: str) -> str:
    return f"""
        SELECT CAST(fold AS INT) AS fold, count(*) AS n,
               round(sqrt(avg(pow(rev_stars - {prediction}, 2))), 6) AS rmse
        FROM {rows} CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold)
        WHERE {held_out("fold", 0.15)} GROUP BY fold"""


_BUSINESS_ROWS = "(SELECT * FROM v_train_reviews JOIN v_train_business USING (business_id))"
_USER_ROWS = "(SELECT * FROM v_train_reviews JOIN v_train_user USING (user_id))"


def _scored(df: DataFrame, prediction: Column) -> DataFrame:
    scores = cross_validate_benchmark(df, prediction, folds=3, share=0.15)
    return scores.select("fold", "n", r6("rmse"))


@query("b6_cv_business_mean", _folds("bus_stars", _BUSINESS_ROWS))
def cv_business(w: Warehouse) -> DataFrame:
    return _scored(_by_business(w), c("bus_stars"))


@query("b6_cv_user_mean", _folds("user_average_stars", _USER_ROWS))
def cv_user(w: Warehouse) -> DataFrame:
    return _scored(_by_user(w), c("user_average_stars"))


@query("b6_cv_global_mean", _folds("(SELECT mean FROM v_global)", _BUSINESS_ROWS))
def cv_global(w: Warehouse) -> DataFrame:
    return _scored(_by_business(w), mean_of(w.train.review, "rev_stars"))


@query("m14_cv_constant", _folds("3.5", _BUSINESS_ROWS))
def cv_constant(w: Warehouse) -> DataFrame:
    return _scored(_by_business(w), F.lit(ops.CONSTANT_STARS))


@query(
    "m14_cv_training_mean",
    f"""WITH marked AS (
          SELECT fold, rev_stars, {held_out("fold", 0.15)} AS held
          FROM {_BUSINESS_ROWS} CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold)),
        means AS (SELECT fold, avg(rev_stars) AS mean FROM marked WHERE NOT held GROUP BY fold)
        SELECT CAST(fold AS INT) AS fold, count(*) AS n,
               round(sqrt(avg(pow(rev_stars - mean, 2))), 6) AS rmse
        FROM marked JOIN means USING (fold) WHERE held GROUP BY fold""",
)
def cv_training_mean(w: Warehouse) -> DataFrame:
    scores = cross_validate_training_mean(_by_business(w), folds=3, share=0.15)
    return scores.select("fold", "n", r6("rmse"))


@query(
    "m14_last_fold_predictions",
    f"""SELECT review_id, rev_stars, bus_stars AS prediction
        FROM {_BUSINESS_ROWS} WHERE {held_out("2", 0.15)}""",
)
def last_fold(w: Warehouse) -> DataFrame:
    rows = benchmark_predictions(_by_business(w), c("bus_stars"), folds=3, share=0.15, fold=2)
    return rows.select("review_id", "rev_stars", "prediction")
