"""Unions and joins of the entities at review grain.

Business and user attributes are put together per business and per user first and staged, so
that the reviews meet each key once, against a plain table. If one business or user holds a
large share of the reviews, the runtime can then split it (adaptive skew join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.sources.staging import stage


def combine(train: Split, test: Split) -> Split:
    """Bag union of both splits; columns known to one side only become NULL on the other."""
    return Split(
        business=train.business.unionByName(test.business, allowMissingColumns=True),
        user=train.user.unionByName(test.user, allowMissingColumns=True),
        checkin=train.checkin.unionByName(test.checkin, allowMissingColumns=True),
    )


def with_checkins(business: DataFrame, checkin: DataFrame) -> DataFrame:
    return business.join(checkin, "business_id", "left")


def join_business(reviews: DataFrame, business: DataFrame, how: str = "inner") -> DataFrame:
    return reviews.join(business, "business_id", how)


def join_user(reviews: DataFrame, user: DataFrame, how: str = "inner") -> DataFrame:
    return reviews.join(user, "user_id", how)


def modelling_set(
    reviews: DataFrame, business: DataFrame, user: DataFrame, checkin: DataFrame
) -> DataFrame:
    """Reviews with a known business and a known user, and check-ins where there are any."""
    wide = stage(with_checkins(business, checkin), "business")
    # The narrow user side first: what the business adds is shuffled once.
    return join_business(join_user(reviews, user), wide)


def master_set(reviews: DataFrame, everything: Split) -> DataFrame:
    """Every review, with whatever is known of its business and user."""
    # A check-in may exist for a business without a record.
    wide = stage(everything.business.join(everything.checkin, "business_id", "full"), "business")
    return join_business(join_user(reviews, everything.user, "left"), wide, "left")


def reattach(matched: DataFrame, reviews: DataFrame, grain: str = "review_id") -> DataFrame:
    """Give reviews without a match their row back, with NULL attributes."""
    attributes = [c for c in matched.columns if c not in reviews.columns]
    return matched.select(grain, *attributes).join(reviews, grain, "right")


def join_pairs(reviews: DataFrame, pairs: DataFrame, how: str = "left") -> DataFrame:
    """Join attributes known per (user, business) pair.

    The pair side is made unique first (least attributes win), so repeated pairs cannot
    multiply the reviews.
    """
    keys = ["user_id", "business_id"]
    attributes = [c for c in pairs.columns if c not in keys]
    unique = pairs.groupBy(*keys).agg(F.min(F.struct(*attributes)).alias("least"))
    return reviews.join(stage(unique.select(*keys, "least.*"), "pairs"), keys, how)


def attach_recommendation_ids(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    return join_pairs(reviews, lookup, "inner")


def users_without_average(test_reviews: DataFrame, train_users: DataFrame) -> DataFrame:
    """Ids of users who wrote test reviews but have no known average."""
    known = train_users.where(F.col("user_average_stars").isNotNull()).select("user_id")
    return test_reviews.select("user_id").distinct().join(known, "user_id", "left_anti")


def missing_user_reviews(
    train_reviews: DataFrame, test_reviews: DataFrame, train_users: DataFrame
) -> DataFrame:
    """Training reviews by users of the test reviews whose average is not known."""
    wanted = stage(users_without_average(test_reviews, train_users), "users")
    return train_reviews.join(wanted, "user_id", "left_semi")


def attach_user_averages(df: DataFrame, averages: DataFrame) -> DataFrame:
    return df.join(stage(averages, "user-averages"), "user_id", "left")


def attach_names(
    df: DataFrame, names: DataFrame, how: str = "left", carriers: DataFrame | None = None
) -> DataFrame:
    """Attach name averages; ``outer`` also appends the names that no row carries, which are
    looked for among ``carriers``, a smaller frame with the same names.

    ``names`` should be a staged table.
    """
    if how == "outer":
        return append_unseen_names(df.join(names, "bus_name", "left"), names, carriers)
    return df.join(names, "bus_name", how)


def append_unseen_names(
    df: DataFrame, names: DataFrame, carriers: DataFrame | None = None
) -> DataFrame:
    """Add a row per name that no row carries.

    An anti-join on the distinct names, because a full outer join could not be split at a
    frequent name. ``carriers`` is a smaller frame with the same names, such as the businesses
    of the rows; without it ``df`` is read twice.
    """
    named = df if carriers is None else carriers
    carried = named.where(F.col("bus_name").isNotNull()).select("bus_name").distinct()
    unseen = names.join(carried, "bus_name", "left_anti")
    return df.unionByName(unseen, allowMissingColumns=True)


def group_businesses(business: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per business, the average of its whole category list, where that list is known."""
    averages = grouped.select(
        "bus_categories",
        F.col("cat_counts").alias("grp_cat_counts"),
        F.col("cat_avg_stars").alias("grp_cat_avg_stars"),
    )
    return business.select("business_id", "bus_categories").join(
        averages, "bus_categories", "left"
    ).drop("bus_categories")


def attach_grouped(df: DataFrame, grouped_businesses: DataFrame) -> DataFrame:
    return df.join(stage(grouped_businesses, "grouped-businesses"), "business_id", "left")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
