"""Joins, unions and the last-row rule."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators import features as feats
from stargauge.operators import joins as ops
from stargauge.operators.cleaning import impute_user_average, last_per_key
from stargauge.operators.features import assemble
from stargauge.operators.sentiment import lexicon_hits
from stargauge.queries.base_sql import SPACE
from stargauge.queries.columns import r6
from stargauge.queries.registry import query
from stargauge.queries.scans import _KEYED_SQL, keyed_reviews
from stargauge.sources.staging import stage
from stargauge.sources.warehouse import Warehouse

c = F.col


@query(
    "j1_review_business",
    """SELECT review_id, business_id, bus_stars, bus_review_count
       FROM v_test_reviews JOIN v_train_business USING (business_id)""",
)
def review_business(w: Warehouse) -> DataFrame:
    joined = ops.join_business(w.test.review, w.train.business)
    return joined.select("review_id", "business_id", "bus_stars", "bus_review_count")


@query(
    "j2_review_user",
    """SELECT review_id, user_id, round(user_average_stars, 6) AS user_average_stars
       FROM v_test_reviews JOIN v_train_user USING (user_id)""",
)
def review_user(w: Warehouse) -> DataFrame:
    joined = ops.join_user(w.test.review, w.train.user)
    return joined.select("review_id", "user_id", r6("user_average_stars"))


_SET = """SELECT review_id, {stars}bus_name, bus_stars, bus_review_count,
                 round(user_average_stars, 6) AS user_average_stars,
                 round(user_review_count, 6) AS user_review_count, total AS checkins
          FROM {view}"""


def _set(df: DataFrame, *extra: str) -> DataFrame:
    total = F.expr("aggregate(map_values(chk_checkin_info), 0L, (acc, n) -> acc + n)")
    return df.select(
        "review_id",
        *extra,
        "bus_name",
        "bus_stars",
        "bus_review_count",
        r6("user_average_stars"),
        r6("user_review_count"),
        total.alias("checkins"),
    )


@query("j3_modelling_set_train", _SET.format(stars="rev_stars, ", view="v_train_all"))
def modelling_train(w: Warehouse) -> DataFrame:
    joined = ops.modelling_set(
        w.train.review, w.train.business, w.train.user, w.everything.checkin
    )
    return _set(joined, "rev_stars")


@query("j3_modelling_set_test", _SET.format(stars="", view="v_test_all"))
def modelling_test(w: Warehouse) -> DataFrame:
    joined = ops.modelling_set(
        w.test.review, w.train.business, w.train.user, w.everything.checkin
    )
    return _set(joined)


@query("j4_master_set", _SET.format(stars="", view="v_master"))
def master(w: Warehouse) -> DataFrame:
    return _set(ops.master_set(w.test.review, w.everything))


@query(
    "j5_reattached",
    """SELECT review_id, user_id, business_id, bus_stars
       FROM v_test_reviews LEFT JOIN v_train_business USING (business_id)""",
)
def reattached(w: Warehouse) -> DataFrame:
    matched = ops.join_business(w.test.review, w.train.business.select("business_id", "bus_stars"))
    whole = ops.reattach(matched, w.test.review)
    return whole.select("review_id", "user_id", "business_id", "bus_stars")


@query(
    "j6_pair_join",
    """SELECT review_id, user_id, business_id,
              round(user_average_stars, 6) AS user_average_stars
       FROM v_test_reviews LEFT JOIN v_train_user USING (user_id)""",
)
def pair_join(w: Warehouse) -> DataFrame:
    pairs = ops.join_user(w.test.review, w.train.user).select(
        "user_id", "business_id", "user_average_stars"
    )
    joined = ops.join_pairs(w.test.review, pairs)
    return joined.select("review_id", "user_id", "business_id", r6("user_average_stars"))


@query("j7_missing_user_reviews", "SELECT review_id, user_id, rev_stars FROM v_missing_users")
def missing_users(w: Warehouse) -> DataFrame:
    rows = ops.missing_user_reviews(w.train.review, w.test.review, w.train.user)
    return rows.select("review_id", "user_id", "rev_stars")


@query(
    "j8_category_lookup",
    """SELECT business_id, round(calc_cat_avg, 6) AS calc_cat_avg,
              round(calc_cat_avg_bus_avg, 6) AS calc_cat_avg_bus_avg
       FROM v_all_business LEFT JOIN v_scores USING (business_id)""",
)
def category_lookup(w: Warehouse) -> DataFrame:
    business = w.everything.business
    scored = feats.attach_category_scores(
        business.select("business_id"),
        business,
        calc_cat_avg=w.dimensions.review_categories,
        calc_cat_avg_bus_avg=w.dimensions.business_categories,
    )
    return scored.select("business_id", r6("calc_cat_avg"), r6("calc_cat_avg_bus_avg"))


@query(
    "j8b_grouped_lookup",
    """SELECT business_id, grp_cat_counts, round(grp_cat_avg_stars, 6) AS grp_cat_avg_stars
       FROM v_grouped_businesses""",
)
def grouped_lookup(w: Warehouse) -> DataFrame:
    grouped = ops.group_businesses(w.everything.business, w.dimensions.grouped_categories)
    attached = ops.attach_grouped(w.everything.business.select("business_id"), grouped)
    return attached.select("business_id", "grp_cat_counts", r6("grp_cat_avg_stars"))


@query(
    "j9_names_outer",
    """SELECT review_id, n.bus_name_counts, round(n.bus_name_avg, 6) AS bus_name_avg
       FROM v_train_all t FULL JOIN (SELECT * FROM v_names WHERE bus_name_counts > 1) n
       ON t.bus_name = n.bus_name""",
)
def names_outer(w: Warehouse) -> DataFrame:
    # The reviews are read once: what is looked up again are the businesses they are of.
    known = ops.join_user(w.train.review, w.train.user.select("user_id"))
    reviews = stage(known.select("review_id", "business_id"), "known-reviews")
    business = w.train.business.select("business_id", "bus_name")
    reviewed = business.join(reviews.select("business_id").distinct(), "business_id", "left_semi")
    shared = w.dimensions.names.where(c("bus_name_counts") > 1)
    attached = ops.attach_names(ops.join_business(reviews, business), shared, "outer", reviewed)
    return attached.select("review_id", "bus_name_counts", r6("bus_name_avg"))


@query(
    "j10_user_averages",
    """SELECT review_id, calc_user_rev_count,
              round(calc_user_avg_stars, 6) AS calc_user_avg_stars
       FROM v_test_reviews LEFT JOIN v_user_averages USING (user_id)""",
)
def user_averages(w: Warehouse) -> DataFrame:
    averages = feats.computed_user_averages(w.train.review, w.test.review, w.train.user)
    attached = ops.attach_user_averages(w.test.review, averages)
    return attached.select("review_id", "calc_user_rev_count", r6("calc_user_avg_stars"))


@query(
    "j11_recommendation_ids",
    """SELECT review_id, RecommendationId
       FROM v_test_reviews JOIN v_lookup USING (user_id, business_id)""",
)
def recommendation_ids(w: Warehouse) -> DataFrame:
    attached = ops.attach_recommendation_ids(w.test.review, w.id_lookup)
    return attached.select("review_id", "RecommendationId")


@query(
    "j12_lexicon_probe",
    f"""SELECT doc_id AS review_id, term, count(*) AS n, CAST(sum(score) AS BIGINT) AS score
        FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{SPACE}')) AS term
              FROM documents)
        JOIN v_lexicon USING (term) GROUP BY ALL""",
)
def lexicon_probe(w: Warehouse) -> DataFrame:
    hits = lexicon_hits(w.review_text, w.lexicon)
    return hits.groupBy("review_id", "term").agg(
        F.count("*").alias("n"), F.sum("score").alias("score")
    )


@query(
    "j13_names_inner",
    """SELECT review_id, bus_name_counts, round(bus_name_avg, 6) AS bus_name_avg
       FROM v_train_reviews JOIN v_train_business USING (business_id)
       JOIN v_names USING (bus_name)""",
)
def names_inner(w: Warehouse) -> DataFrame:
    train = ops.join_business(w.train.review, w.train.business)
    named = ops.attach_names(train, w.dimensions.names, "inner")
    return named.select("review_id", "bus_name_counts", r6("bus_name_avg"))


@query("w1_last_row_per_key", _KEYED_SQL)
def last_row(w: Warehouse) -> DataFrame:
    return last_per_key(keyed_reviews(w), "review_id", "sequence")


@query(
    "u1_combined_business",
    """SELECT business_id, bus_name, bus_review_count, bus_stars, bus_zip_code
       FROM v_all_business""",
)
def combined_business(w: Warehouse) -> DataFrame:
    return w.everything.business.select(
        "business_id", "bus_name", "bus_review_count", "bus_stars", "bus_zip_code"
    )


@query(
    "u1_combined_user",
    """SELECT user_id, user_name, round(user_review_count, 6) AS user_review_count,
              round(user_average_stars, 6) AS user_average_stars FROM v_all_user""",
)
def combined_user(w: Warehouse) -> DataFrame:
    return w.everything.user.select(
        "user_id", "user_name", r6("user_review_count"), r6("user_average_stars")
    )


@query(
    "u1_combined_checkin",
    """SELECT user_id AS business_id, concat(hour(ts), '-', event_type) AS slot, count(*) AS n
       FROM events GROUP BY ALL""",
)
def combined_checkin(w: Warehouse) -> DataFrame:
    return w.everything.checkin.select(
        "business_id", F.explode("chk_checkin_info").alias("slot", "n")
    )


@query(
    "u2_complementary_filters",
    """SELECT review_id, round(CASE WHEN bus_review_count >= user_review_count THEN bus_stars
              ELSE user_average_stars END, 6) AS stars FROM v_test_all""",
)
def complementary(w: Warehouse) -> DataFrame:
    known = ops.join_user(ops.join_business(w.test.review, w.train.business), w.train.user)
    more = c("bus_review_count") >= c("user_review_count")
    stars = F.when(more, c("bus_stars")).otherwise(c("user_average_stars"))
    return known.select("review_id", r6(stars, "stars"))


@query(
    "u3_imputed_and_known",
    """SELECT user_id, round(coalesce(user_average_stars, calc_user_avg_stars), 6)
              AS user_average_stars
       FROM v_all_user LEFT JOIN v_user_averages USING (user_id)
       WHERE coalesce(user_average_stars, calc_user_avg_stars) IS NOT NULL""",
)
def imputed_and_known(w: Warehouse) -> DataFrame:
    averages = feats.computed_user_averages(w.train.review, w.test.review, w.train.user)
    users = impute_user_average(ops.attach_user_averages(w.everything.user, averages))
    known = users.where(c("user_average_stars").isNotNull())
    return known.select("user_id", r6("user_average_stars"))


@query(
    "u4_side_by_side",
    """SELECT review_id, CAST(3 AS BIGINT) AS width,
              bus_stars + bus_review_count
              + CASE WHEN bus_open THEN 1 ELSE 0 END AS total
       FROM v_test_reviews JOIN v_train_business USING (business_id)""",
)
def side_by_side(w: Warehouse) -> DataFrame:
    rows = ops.join_business(w.test.review, w.train.business)
    (flagged,) = feats.one_hot(w.train.business, [rows], "bus_open")
    joined = assemble(flagged, ["bus_stars", "bus_review_count", "bus_open_vector"])
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
    return joined.select(
        "review_id", F.size(values).cast("bigint").alias("width"), total.alias("total")
    )
