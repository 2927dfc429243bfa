"""Feature sets, encodings and scaling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators import features as ops
from stargauge.operators.joins import join_business, join_user
from stargauge.plans.modelling import ReviewSets
from stargauge.queries.columns import r6, text_list
from stargauge.queries.registry import query
from stargauge.sources.warehouse import Warehouse

c = F.col

_TRAIN_SQL = """
    SELECT review_id, rev_stars, bus_name, array_to_string(bus_categories, '|') AS bus_categories,
           bus_open, bus_zip_code, bus_review_count, bus_stars,
           round(user_review_count, 6) AS user_review_count,
           round(user_average_stars, 6) AS user_average_stars, calc_total_checkins,
           round(calc_cat_avg, 6) AS calc_cat_avg,
           round(calc_cat_avg_bus_avg, 6) AS calc_cat_avg_bus_avg,
           bus_name_counts, round(bus_name_avg, 6) AS bus_name_avg,
           grp_cat_counts, round(grp_cat_avg_stars, 6) AS grp_cat_avg_stars
    FROM v_train_set"""


@query("h0_train_features", _TRAIN_SQL)
def train_features(w: Warehouse) -> DataFrame:
    return w.sets.train.select(
        "review_id", "rev_stars", "bus_name", text_list("bus_categories"), "bus_open",
        "bus_zip_code", "bus_review_count", "bus_stars", r6("user_review_count"),
        r6("user_average_stars"), "calc_total_checkins", r6("calc_cat_avg"),
        r6("calc_cat_avg_bus_avg"), "bus_name_counts", r6("bus_name_avg"), "grp_cat_counts",
        r6("grp_cat_avg_stars"),
    )


@query(
    "h0_test_features",
    """SELECT review_id, bus_name, bus_open, bus_zip_code, bus_review_count, bus_stars,
              round(user_review_count, 6) AS user_review_count,
              round(user_average_stars, 6) AS user_average_stars, calc_total_checkins,
              round(calc_cat_avg, 6) AS calc_cat_avg FROM v_test_set""",
)
def test_features(w: Warehouse) -> DataFrame:
    return w.sets.test.select(
        "review_id", "bus_name", "bus_open", "bus_zip_code", "bus_review_count", "bus_stars",
        r6("user_review_count"), r6("user_average_stars"), "calc_total_checkins",
        r6("calc_cat_avg"),
    )


MASTER_SQL = """
    SELECT review_id, bus_name, bus_open, bus_zip_code, bus_review_count, bus_stars,
           round(user_review_count, 6) AS user_review_count,
           round(user_average_stars, 6) AS user_average_stars, calc_user_rev_count,
           round(calc_user_avg_stars, 6) AS calc_user_avg_stars, calc_total_checkins,
           round(calc_cat_avg, 6) AS calc_cat_avg,
           round(calc_cat_avg_bus_avg, 6) AS calc_cat_avg_bus_avg,
           bus_name_counts, round(bus_name_avg, 6) AS bus_name_avg,
           grp_cat_counts, round(grp_cat_avg_stars, 6) AS grp_cat_avg_stars
    FROM v_master_set"""


@query("h0_master_features", MASTER_SQL)
def master_features(w: Warehouse) -> DataFrame:
    return w.sets.master.select(
        "review_id", "bus_name", "bus_open", "bus_zip_code", "bus_review_count", "bus_stars",
        r6("user_review_count"), r6("user_average_stars"), "calc_user_rev_count",
        r6("calc_user_avg_stars"), "calc_total_checkins", r6("calc_cat_avg"),
        r6("calc_cat_avg_bus_avg"), "bus_name_counts", r6("bus_name_avg"), "grp_cat_counts",
        r6("grp_cat_avg_stars"),
    )


@query(
    "h0_master_features_outer",
    """SELECT review_id, n.bus_name_counts, round(n.bus_name_avg, 6) AS bus_name_avg,
              calc_total_checkins
       FROM v_master_set m FULL JOIN v_names n ON m.bus_name = n.bus_name""",
)
def master_features_outer(w: Warehouse) -> DataFrame:
    sets = ReviewSets(w.train, w.test, w.everything, w.dimensions, names="outer")
    return sets.master.select(
        "review_id", "bus_name_counts", r6("bus_name_avg"), "calc_total_checkins"
    )


@query(
    "m1_one_hot_slots",
    """WITH slots AS (SELECT bus_zip_code, row_number() OVER (ORDER BY bus_zip_code) - 1 AS slot
                      FROM (SELECT DISTINCT bus_zip_code FROM v_train_business))
       SELECT business_id, (SELECT count(*) FROM slots) AS width, slot,
              CAST(slot IS NOT NULL AS DOUBLE) AS ones
       FROM v_all_business LEFT JOIN slots USING (bus_zip_code)""",
)
def one_hot_slots(w: Warehouse) -> DataFrame:
    (encoded,) = ops.one_hot(w.train.business, [w.everything.business], "bus_zip_code")
    values = vector_to_array("bus_zip_code_vector")
    ones = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
    slot = F.when(ones > 0, c("bus_zip_code_index").cast("bigint"))
    width = F.size(values).cast("bigint")
    return encoded.select(
        "business_id", width.alias("width"), slot.alias("slot"), ones.alias("ones")
    )


@query(
    "m1_one_hot_long",
    """SELECT review_id, bus_name AS value FROM v_test_reviews
       JOIN v_all_business USING (business_id)
       WHERE bus_name IN (SELECT bus_name FROM v_train_business WHERE bus_name IS NOT NULL)""",
)
def one_hot_long(w: Warehouse) -> DataFrame:
    reviews = join_business(w.test.review, w.everything.business.select("business_id", "bus_name"))
    return ops.one_hot_long(w.train.business, reviews, "bus_name")


@query(
    "m2_boolean_flag",
    """SELECT review_id, CASE WHEN bus_open IS NOT NULL THEN CAST(1 AS BIGINT) END AS width,
              CAST(bus_open AS INT) * 1.0::DOUBLE AS flag
       FROM v_master""",
)
def boolean_flag(w: Warehouse) -> DataFrame:
    reviews = join_business(w.test.review, w.everything.business, "left")
    (encoded,) = ops.one_hot(w.train.business, [reviews], "bus_open")
    values = F.when(c("bus_open").isNotNull(), vector_to_array("bus_open_vector"))
    return encoded.select(
        "review_id",
        F.when(values.isNotNull(), F.size(values)).cast("bigint").alias("width"),
        values[0].alias("flag"),
    )


@query(
    "m3_multi_hot_long",
    """WITH words AS (SELECT category, count(*) AS n
                      FROM (SELECT unnest(bus_categories) AS category FROM v_master)
                      GROUP BY category ORDER BY n DESC, category LIMIT 450)
       SELECT DISTINCT review_id, category
       FROM (SELECT review_id, unnest(bus_categories) AS category FROM v_test_all)
       JOIN words USING (category)""",
)
def multi_hot_long(w: Warehouse) -> DataFrame:
    vocabulary = ops.review_vocabulary(w.test.review, w.everything.business)
    known = join_user(w.test.review, w.train.user.select("user_id"))
    return ops.multi_hot_long_by_business(known, w.train.business, vocabulary)


@query(
    "m3_multi_hot_vectors",
    """WITH words AS (SELECT category, count(*) AS n
                      FROM (SELECT unnest(bus_categories) AS category FROM v_master)
                      GROUP BY category ORDER BY n DESC, category LIMIT 450)
       SELECT review_id, (SELECT count(*) FROM words) AS width,
              CAST(count(DISTINCT words.category) AS DOUBLE) AS ones
       FROM v_master
       LEFT JOIN (SELECT business_id, unnest(bus_categories) AS category FROM v_all_business)
            USING (business_id)
       LEFT JOIN words USING (category) GROUP BY review_id""",
)
def multi_hot_vectors(w: Warehouse) -> DataFrame:
    vocabulary = ops.review_vocabulary(w.test.review, w.everything.business)
    encoded, _ = ops.multi_hot_by_business(w.test.review, w.everything.business, vocabulary)
    values = vector_to_array("category_vector")
    ones = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
    return encoded.select(
        "review_id", F.size(values).cast("bigint").alias("width"), ones.alias("ones")
    )


@query(
    "m4_standardized",
    """WITH k AS (SELECT avg(bus_stars) AS m1, stddev_pop(bus_stars) AS s1,
                         avg(user_average_stars) AS m2, stddev_pop(user_average_stars) AS s2,
                         avg(calc_total_checkins) AS m3, stddev_pop(calc_total_checkins) AS s3
                  FROM v_train_set)
       SELECT review_id, round((bus_stars - m1) / s1, 6) AS bus_stars_scaled,
              round((user_average_stars - m2) / s2, 6) AS user_average_stars_scaled,
              round((calc_total_checkins - m3) / s3, 6) AS calc_total_checkins_scaled
       FROM v_test_set CROSS JOIN k""",
)
def standardized(w: Warehouse) -> DataFrame:
    names = ["bus_stars", "user_average_stars", "calc_total_checkins"]
    (scaled,) = ops.standardize(w.sets.train, [w.sets.test], names)
    return scaled.select("review_id", *[r6(f"{name}_scaled") for name in names])


@query(
    "m5_assembled",
    """SELECT review_id, CAST(6 AS BIGINT) AS width,
              round(bus_stars + user_average_stars + bus_review_count + user_review_count
                    + calc_total_checkins + calc_cat_avg, 5) AS total
       FROM v_test_set""",
)
def assembled(w: Warehouse) -> DataFrame:
    rows = ops.assemble(w.sets.test, ops.QUANT_FEATURES)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
    return rows.select(
        "review_id",
        F.size(values).cast("bigint").alias("width"),
        F.round(total, 5).alias("total"),
    )
