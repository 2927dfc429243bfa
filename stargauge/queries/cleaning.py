"""Projections and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.functions import numeric, text
from stargauge.operators import cleaning as ops
from stargauge.operators.benchmarks import known_stars
from stargauge.operators.features import (
    CATEGORY_FILL,
    GROUPED_FILL,
    attach_category_scores,
)
from stargauge.operators.joins import attach_grouped, group_businesses
from stargauge.operators.subsets import subset
from stargauge.queries.columns import r6, text_list
from stargauge.queries.registry import query
from stargauge.sources.warehouse import Warehouse

c = F.col


@query(
    "p1_prefixed_columns",
    """SELECT user_id, name AS user_name, review_count AS user_review_count,
              round(average_stars, 6) AS user_average_stars
       FROM v_raw_user WHERE is_train""",
)
def prefixed(w: Warehouse) -> DataFrame:
    named = ops.prefix_columns(w.raw_train.user, ops.PREFIXES["user"])
    return named.select("user_id", "user_name", "user_review_count", r6("user_average_stars"))


@query(
    "p2_pruned_columns",
    """SELECT business_id, name, review_count, is_open AS open,
              array_to_string(categories, '|') AS categories
       FROM v_raw_business WHERE is_train""",
)
def pruned(w: Warehouse) -> DataFrame:
    kept = ops.prune(w.raw_train.business, ops.UNUSED["train", "business"])
    kept = ops.prune(kept, ["longitude", "latitude", "stars"])
    return kept.withColumn("categories", text_list("categories"))


@query(
    "p3_names",
    "SELECT business_id AS id, bus_name AS name FROM v_all_business "
    "UNION ALL SELECT user_id, user_name FROM v_all_user",
)
def names(w: Warehouse) -> DataFrame:
    both = w.everything
    business = both.business.select(c("business_id").alias("id"), c("bus_name").alias("name"))
    return business.unionAll(both.user.select("user_id", "user_name"))


@query("p4_zip_code", "SELECT business_id, bus_zip_code AS zip_code FROM v_all_business")
def zip_codes(w: Warehouse) -> DataFrame:
    addresses = w.raw_train.business.unionByName(w.raw_test.business, allowMissingColumns=True)
    return addresses.select("business_id", text.zip_code(c("full_address")).alias("zip_code"))


@query(
    "p5_rounded_coordinates",
    """SELECT business_id, round(longitude, 2) AS longitude_rounded2,
              round(latitude, 2) AS latitude_rounded2 FROM v_raw_business""",
)
def rounded(w: Warehouse) -> DataFrame:
    business = w.raw_train.business.unionByName(w.raw_test.business, allowMissingColumns=True)
    return ops.derive_business(business).select(
        "business_id", "longitude_rounded2", "latitude_rounded2"
    )


@query(
    "p6_flat_categories",
    """SELECT business_id,
              CASE WHEN len(bus_categories) > 0
                   THEN '-' || array_to_string(bus_categories, '-') ELSE 'MISSING' END AS flat
       FROM v_all_business""",
)
def flat(w: Warehouse) -> DataFrame:
    flattened = text.flat_categories(c("bus_categories")).alias("flat")
    return w.everything.business.select("business_id", flattened)


@query(
    "p7_low_averages_raised",
    "SELECT user_id, round(user_average_stars, 6) AS average_stars FROM v_train_user",
)
def low_averages(w: Warehouse) -> DataFrame:
    return ops.clean_train_users(w.raw_train.user).select("user_id", r6("average_stars"))


@query(
    "p8_low_counts_raised",
    "SELECT user_id, round(user_review_count, 6) AS review_count FROM v_test_user",
)
def low_counts(w: Warehouse) -> DataFrame:
    cleaned = ops.clean_test_users(w.raw_test.user, w.raw_train.user)
    return cleaned.select("user_id", r6("review_count"))


@query("p9_label_subset", "SELECT review_id, rev_stars FROM v_train_reviews")
def labels(w: Warehouse) -> DataFrame:
    return ops.pick(w.train.review, ["review_id", "rev_stars"])


@query(
    "p10_narrow_types",
    """SELECT review_id, CAST(rev_stars AS TINYINT) AS rev_stars,
              CAST(bus_review_count AS INT) AS bus_review_count
       FROM v_train_reviews JOIN v_train_business USING (business_id)""",
)
def narrow(w: Warehouse) -> DataFrame:
    review = ops.narrow_types(w.train.review, {"rev_stars": "tinyint"})
    business = ops.narrow_types(w.train.business, {"bus_review_count": "int"})
    joined = review.join(business, "business_id")
    return joined.select("review_id", "rev_stars", "bus_review_count")


@query(
    "p11_constant_fill",
    """SELECT b.business_id, round(coalesce(calc_cat_avg, 3.766723066), 6) AS calc_cat_avg,
              round(coalesce(grp_cat_avg_stars, 3.8), 6) AS grp_cat_avg_stars
       FROM v_all_business b LEFT JOIN v_scores USING (business_id)
       LEFT JOIN v_grouped_businesses USING (business_id)""",
)
def constant_fill(w: Warehouse) -> DataFrame:
    business = w.everything.business
    scored = attach_category_scores(
        business.select("business_id"), business, calc_cat_avg=w.dimensions.review_categories
    )
    both = attach_grouped(scored, group_businesses(business, w.dimensions.grouped_categories))
    filled = ops.fill_null(both, "calc_cat_avg", CATEGORY_FILL)
    filled = ops.fill_null(filled, "grp_cat_avg_stars", GROUPED_FILL)
    return filled.select("business_id", r6("calc_cat_avg"), r6("grp_cat_avg_stars"))


@query(
    "p12_mean_fill",
    """SELECT user_id, round(coalesce(user_average_stars,
              (SELECT avg(user_average_stars) FROM v_all_user)), 6) AS user_average_stars
       FROM v_all_user""",
)
def mean_fill(w: Warehouse) -> DataFrame:
    users = w.everything.user
    filled = ops.fill_null(users, "user_average_stars", ops.mean_of(users, "user_average_stars"))
    return filled.select("user_id", r6("user_average_stars"))


@query(
    "p13_first_positive",
    """SELECT review_id,
              round(CASE WHEN bus_stars > 0 THEN bus_stars
                         WHEN user_average_stars > 0 THEN user_average_stars
                         ELSE 3.0 END, 6) AS stars
       FROM v_test_reviews LEFT JOIN v_train_business USING (business_id)
       LEFT JOIN v_train_user USING (user_id)""",
)
def first_positive(w: Warehouse) -> DataFrame:
    stars = numeric.first_positive(c("bus_stars"), c("user_average_stars"), otherwise=F.lit(3.0))
    return known_stars(w.test.review, w.train).select("review_id", r6(stars, "stars"))


@query(
    "p14_clamped",
    """SELECT business_id, least(greatest(bus_stars, 1.3), 4.85) AS low_high, bus_stars AS free
       FROM v_train_business""",
)
def clamped(w: Warehouse) -> DataFrame:
    stars = c("bus_stars")
    return w.train.business.select(
        "business_id",
        numeric.clamp(stars, 1.3, 4.85).alias("low_high"),
        numeric.clamp(stars).alias("free"),
    )


@query(
    "p16_imputed_user_average",
    """SELECT review_id,
              round(coalesce(user_average_stars, calc_user_avg_stars), 6) AS user_average_stars
       FROM v_master_set WHERE bus_stars IS NULL AND bus_name_counts = 1""",
)
def imputed(w: Warehouse) -> DataFrame:
    rows = subset(w.subset_sources, "names_1_test")
    return ops.impute_user_average(rows).select("review_id", r6("user_average_stars"))


@query(
    "p18_missing_list",
    """SELECT business_id, array_to_string(
              CASE WHEN len(bus_categories) > 0 THEN bus_categories ELSE ['MISSING'] END, '|')
              AS bus_categories
       FROM v_all_business""",
)
def missing_list(w: Warehouse) -> DataFrame:
    lists = text.categories_or_missing(c("bus_categories"))
    return w.everything.business.select(
        "business_id", F.array_join(lists, "|").alias("bus_categories")
    )
