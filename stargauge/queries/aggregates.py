"""Aggregations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators import dimensions as dims
from stargauge.operators import features as feats
from stargauge.operators.benchmarks import business_user_mean
from stargauge.operators.cleaning import mean_of
from stargauge.operators.joins import join_business, join_user
from stargauge.operators.models import LABEL, cross_validate_benchmark, mean_score
from stargauge.operators.sentiment import sentiment_scores
from stargauge.queries.base_sql import SPACE, held_out
from stargauge.queries.columns import r6, text_list
from stargauge.queries.registry import query
from stargauge.sources.warehouse import Warehouse

c = F.col

@query(
    "a1_global_mean",
    """SELECT round(avg(rev_stars), 6) AS mean_stars,
              (SELECT round(avg(average_stars), 6) FROM v_raw_user WHERE is_train) AS mean_user
       FROM v_train_reviews""",
)
def global_mean(w: Warehouse) -> DataFrame:
    mean_user = mean_of(w.raw_train.user, "average_stars")
    means = w.train.review.agg(F.avg("rev_stars").alias("mean_stars"))
    return means.select(r6("mean_stars"), r6(mean_user, "mean_user"))


@query(
    "a2_category_counts",
    """SELECT category, count(*) AS n
       FROM (SELECT unnest(bus_categories) AS category FROM v_all_business) GROUP BY category""",
)
def category_counts(w: Warehouse) -> DataFrame:
    return dims.category_counts(w.everything.business)


@query(
    "a2_name_counts",
    """SELECT bus_name, count(*) AS n FROM v_all_business
       WHERE bus_name IS NOT NULL GROUP BY bus_name""",
)
def name_counts(w: Warehouse) -> DataFrame:
    return dims.value_counts(w.everything.business, "bus_name")


def _from_reviews(w: Warehouse, k: int) -> DataFrame:
    train = w.train
    return dims.category_averages_from_reviews(train.review, train.business, train.user, k)


@query(
    "a3_review_category_averages",
    """SELECT category, cat_count, round(cat_avg_stars, 6) AS cat_avg_stars
       FROM v_review_categories""",
)
def review_category_averages(w: Warehouse) -> DataFrame:
    averages = _from_reviews(w, dims.TOP_CATEGORIES)
    return averages.select("category", "cat_count", r6("cat_avg_stars"))


@query(
    "a4_business_category_averages",
    """SELECT category, cat_tot_count, round(cat_avg_stars, 6) AS cat_avg_stars
       FROM v_business_categories""",
)
def business_category_averages(w: Warehouse) -> DataFrame:
    averages = dims.category_averages_from_businesses(w.everything.business)
    return averages.select("category", "cat_tot_count", r6("cat_avg_stars"))


@query(
    "a5_grouped_category_averages",
    """SELECT array_to_string(bus_categories, '|') AS bus_categories, cat_counts,
              round(cat_avg_stars, 6) AS cat_avg_stars FROM v_grouped_categories""",
)
def grouped_category_averages(w: Warehouse) -> DataFrame:
    averages = dims.grouped_category_averages(w.everything.business)
    return averages.select(text_list("bus_categories"), "cat_counts", r6("cat_avg_stars"))


@query(
    "a6_name_averages",
    """SELECT bus_name, bus_name_counts, total_stars, round(bus_name_avg, 6) AS bus_name_avg
       FROM v_names""",
)
def name_averages(w: Warehouse) -> DataFrame:
    averages = dims.name_averages(w.train.business)
    return averages.select("bus_name", "bus_name_counts", "total_stars", r6("bus_name_avg"))


@query(
    "a7_computed_user_averages",
    """SELECT user_id, calc_user_rev_count, round(calc_user_avg_stars, 6) AS calc_user_avg_stars
       FROM v_user_averages""",
)
def computed_user_averages(w: Warehouse) -> DataFrame:
    averages = feats.computed_user_averages(w.train.review, w.test.review, w.train.user)
    return averages.select("user_id", "calc_user_rev_count", r6("calc_user_avg_stars"))


A8_SQL = """SELECT business_id, coalesce(total, 0) AS calc_total_checkins
       FROM v_all_business LEFT JOIN v_checkin USING (business_id)"""


@query(
    "a8_total_checkins",
    A8_SQL,
)
def total_checkins(w: Warehouse) -> DataFrame:
    everything = w.everything
    joined = everything.business.join(everything.checkin, "business_id", "left")
    return feats.with_total_checkins(joined).select("business_id", "calc_total_checkins")


@query(
    "a9_category_average_per_review",
    """SELECT review_id, round(calc_cat_avg, 6) AS calc_cat_avg
       FROM v_test_reviews LEFT JOIN v_scores USING (business_id)""",
)
def category_average_per_review(w: Warehouse) -> DataFrame:
    scored = feats.attach_category_scores(
        w.test.review, w.everything.business, calc_cat_avg=w.dimensions.review_categories
    )
    return scored.select("review_id", r6("calc_cat_avg"))


A10_SQL = f"""SELECT doc_id AS review_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS score
        FROM (SELECT doc_id, unnest(CASE WHEN len(words) > 0 THEN words ELSE [NULL] END) AS term
              FROM (SELECT doc_id, regexp_split_to_array(text, '{SPACE}') AS words
                    FROM documents))
        LEFT JOIN v_lexicon USING (term) GROUP BY doc_id"""


@query(
    "a10_sentiment_score",
    A10_SQL,
)
def sentiment_score(w: Warehouse) -> DataFrame:
    return sentiment_scores(w.review_text, w.lexicon)


@query(
    "a11_extremes",
    "SELECT min(rev_stars) AS min_value, max(rev_stars) AS max_value FROM v_train_reviews",
)
def extremes(w: Warehouse) -> DataFrame:
    return dims.extremes(w.train.review, "rev_stars")


@query("a12_distinct_users", "SELECT DISTINCT user_id FROM v_test_reviews")
def distinct_users(w: Warehouse) -> DataFrame:
    return dims.distinct_values(w.test.review, "user_id")


def _rated(w: Warehouse) -> DataFrame:
    """Training reviews with the stars known of their business and user."""
    train = w.train
    business = train.business.select("business_id", "bus_stars")
    user = train.user.select("user_id", "user_average_stars")
    return join_user(join_business(train.review, business), user)


_RATED_FOLDS = f"""
    SELECT fold, round(sqrt(avg(pow(rev_stars - bus_stars, 2))), 6) AS rmse
    FROM v_train_all CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold)
    WHERE {held_out("fold", 0.15)} GROUP BY fold"""


@query(
    "a13_rmse_over_folds", f"SELECT round(avg(rmse), 5) AS mean_rmse FROM ({_RATED_FOLDS})"
)
def rmse_over_folds(w: Warehouse) -> DataFrame:
    scores = cross_validate_benchmark(_rated(w), c("bus_stars"), folds=3)
    return mean_score(scores.select("fold", r6("rmse"))).select(
        F.round("mean_rmse", 5).alias("mean_rmse")
    )


@query(
    "a14_moments",
    """SELECT round(avg(bus_stars), 6) AS bus_stars_mean,
              round(avg(user_average_stars), 6) AS user_average_stars_mean,
              round(stddev_pop(bus_stars), 6) AS bus_stars_std,
              round(stddev_pop(user_average_stars), 6) AS user_average_stars_std
       FROM v_train_all""",
)
def moments(w: Warehouse) -> DataFrame:
    fitted = feats.moments(_rated(w), ["bus_stars", "user_average_stars"])
    return fitted.select(*[r6(name) for name in fitted.columns])


@query(
    "l1_top_categories",
    """SELECT category, cat_count FROM v_review_categories
       ORDER BY cat_count DESC, category LIMIT 421""",
)
def top_categories(w: Warehouse) -> DataFrame:
    return _from_reviews(w, dims.TOP_CATEGORIES).select("category", "cat_count")


@query(
    "l2_vocabulary",
    """SELECT category, count(*) AS n
       FROM (SELECT unnest(bus_categories) AS category FROM v_master)
       GROUP BY category ORDER BY n DESC, category LIMIT 450""",
)
def vocabulary(w: Warehouse) -> DataFrame:
    reviews = join_business(w.test.review, w.everything.business, "left")
    return dims.category_vocabulary(reviews)


@query(
    "l3_top_review_counts",
    """SELECT bus_review_count, count(*) AS n FROM v_all_business
       GROUP BY bus_review_count ORDER BY n DESC, bus_review_count LIMIT 10""",
)
def top_review_counts(w: Warehouse) -> DataFrame:
    return dims.review_count_values(w.everything)


@query(
    "l4_first_rows",
    """SELECT review_id, rev_stars FROM v_train_reviews ORDER BY review_id LIMIT 10000""",
)
def first_rows(w: Warehouse) -> DataFrame:
    return dims.first_rows(w.train.review, ["review_id"]).select("review_id", "rev_stars")


@query(
    "l5_best_candidate",
    """SELECT feature, round(score, 6) AS score FROM (
         SELECT 'bus_stars' AS feature, abs(corr(bus_stars, rev_stars)) AS score FROM v_train_all
         UNION ALL
         SELECT 'user_average_stars', abs(corr(user_average_stars, rev_stars)) FROM v_train_all)
       ORDER BY score DESC, feature DESC LIMIT 1""",
)
def best(w: Warehouse) -> DataFrame:
    candidates = ["bus_stars", "user_average_stars"]
    scores = _rated(w).agg(
        F.array(
            *[
                F.struct(F.abs(F.corr(name, LABEL)).alias("score"), F.lit(name).alias("feature"))
                for name in candidates
            ]
        ).alias("scores")
    )
    top = dims.best_candidate(scores.select(F.inline("scores")), "score", "feature")
    return top.select("feature", r6("score"))


@query(
    "b3_mean_predictions",
    """SELECT round(avg(CASE WHEN bus_stars > 0 THEN bus_stars
              WHEN user_average_stars > 0 THEN user_average_stars
              ELSE (SELECT mean FROM v_global) END), 6) AS mean_prediction, count(*) AS n
       FROM v_test_reviews LEFT JOIN v_train_business USING (business_id)
       LEFT JOIN v_train_user USING (user_id)""",
)
def mean_predictions(w: Warehouse) -> DataFrame:
    scored = business_user_mean(w.test.review, w.train)
    return scored.agg(
        F.avg("benchmark_bus_usr_mean").alias("mean_prediction"), F.count("*").alias("n")
    ).select(r6("mean_prediction"), "n")
