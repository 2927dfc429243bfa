"""Average-star dimensions, value counts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stargauge.frames import Split

# Cut-offs of the dimensions.
TOP_CATEGORIES = 421
VOCABULARY_SIZE = 450
MIN_REVIEWS_PER_CATEGORY_BUSINESS = 3
MIN_BUSINESSES_PER_CATEGORY = 2
MIN_REVIEWS_PER_GROUPED_BUSINESS = 4


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def extremes(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def exploded(df: DataFrame, column: str, name: str, *carry: str) -> DataFrame:
    """One row per list element; a repeated element counts each time."""
    return df.select(F.explode(column).alias(name), *carry)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; NULL is not counted."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    """Rows per category. Rows are counted per business first, where there is one, so that one
    list a business is taken apart."""
    keys = [name for name in ("business_id", "bus_categories") if name in df.columns]
    per_list = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return (
        exploded(per_list, "bus_categories", "category", "n")
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("n").alias("n"))
    )


def top_k(df: DataFrame, count: str, key: str, k: int) -> DataFrame:
    """The ``k`` highest counts; ties are cut by name."""
    return df.orderBy(F.desc(count), F.asc(key)).limit(k)


def category_vocabulary(df: DataFrame, k: int = VOCABULARY_SIZE) -> DataFrame:
    return top_k(category_counts(df), "n", "category", k)


def first_rows(df: DataFrame, keys: list[str], n: int = 10_000, groups: int = 64) -> DataFrame:
    """The first ``n`` rows in key order.

    Every task hands on its own first ``n`` rows to one of ``groups`` tasks, and those theirs to
    the last, which so reads ``groups * n`` rows at most, however many input partitions there are.
    """
    order = Window.partitionBy("_group").orderBy(*keys)
    grouped = df.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    ranked = grouped.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    return ranked.drop("_group", "_rank").orderBy(*keys).limit(n)


def category_averages_from_reviews(
    reviews: DataFrame, business: DataFrame, user: DataFrame, k: int = TOP_CATEGORIES
) -> DataFrame:
    """Average review stars of the ``k`` most reviewed categories.

    Reviews of known users are summed up per business before the categories are looked at, so
    only business totals, not reviews, are joined and exploded.
    """
    totals = (
        reviews.join(user.select("user_id"), "user_id", "left_semi")
        .groupBy("business_id")
        .agg(F.count("*").alias("n"), F.sum("rev_stars").alias("stars"))
    )
    per_business = totals.join(business.select("business_id", "bus_categories"), "business_id")
    averages = (
        exploded(per_business, "bus_categories", "category", "n", "stars")
        .groupBy("category")
        .agg(
            F.sum("n").alias("cat_count"),
            F.try_divide(F.sum("stars"), F.sum("n")).alias("cat_avg_stars"),
        )
    )
    return top_k(averages, "cat_count", "category", k)


def rated_businesses(business: DataFrame, more_than: int) -> DataFrame:
    """Businesses with a star value and more than so many reviews."""
    return business.where((F.col("bus_review_count") > more_than) & (F.col("bus_stars") > 0))


def category_averages_from_businesses(business: DataFrame) -> DataFrame:
    """Average business stars of the categories that are on more than two businesses."""
    rated = rated_businesses(business, MIN_REVIEWS_PER_CATEGORY_BUSINESS)
    return (
        exploded(rated, "bus_categories", "category", "bus_stars")
        .groupBy("category")
        .agg(
            F.count("*").cast("double").alias("cat_tot_count"),
            F.avg("bus_stars").alias("cat_avg_stars"),
        )
        .where(F.col("cat_tot_count") > MIN_BUSINESSES_PER_CATEGORY)
    )


def grouped_category_averages(business: DataFrame) -> DataFrame:
    """Average business stars per whole category list, in the list's own order.

    Businesses without a category are counted, but their total stays 0.
    """
    total = F.when(F.size("bus_categories") > 0, F.sum("bus_stars")).otherwise(F.lit(0.0))
    return (
        rated_businesses(business, MIN_REVIEWS_PER_GROUPED_BUSINESS)
        .where(F.col("bus_categories").isNotNull())
        .groupBy("bus_categories")
        .agg(F.count("*").alias("cat_counts"), (total / F.count("*")).alias("cat_avg_stars"))
    )


def name_averages(business: DataFrame) -> DataFrame:
    """Average stars of the businesses that share a name."""
    return (
        business.where(F.col("bus_name").isNotNull())
        .groupBy("bus_name")
        .agg(
            F.count("*").alias("bus_name_counts"),
            F.sum("bus_stars").alias("total_stars"),
            F.avg("bus_stars").alias("bus_name_avg"),
        )
    )


def review_count_values(everything: Split, k: int = 10) -> DataFrame:
    """The ``k`` most frequent review counts of the businesses."""
    return top_k(
        value_counts(everything.business, "bus_review_count"), "n", "bus_review_count", k
    )


def best_candidate(scores: DataFrame, score: str, name: str) -> DataFrame:
    """The candidate with the highest score; ties go to the last name."""
    best = F.max(F.struct(score, name)).alias("best")
    return scores.agg(best).select(F.col(f"best.{name}"), F.col(f"best.{score}"))
