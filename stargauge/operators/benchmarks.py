"""Baseline predictors that fall back from business to user to global mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.functions.numeric import first_positive, held_out
from stargauge.operators.cleaning import mean_of
from stargauge.operators.joins import join_business, join_user
from stargauge.sources.staging import stage

# Fixed value: the constant predictor.
CONSTANT_STARS = 3.5

KEYS = ["review_id", "user_id", "business_id"]


def _business_stars(train: Split) -> DataFrame:
    return train.business.select("business_id", "bus_stars", "bus_review_count")


def _user_stars(train: Split) -> DataFrame:
    return train.user.select("user_id", "user_average_stars", "user_review_count")


def global_mean(train: Split) -> Column:
    return mean_of(train.review, "rev_stars")


def business_mean(reviews: DataFrame, train: Split) -> DataFrame:
    known = join_business(reviews.select(*KEYS), _business_stars(train), "left")
    value = F.coalesce(F.col("bus_stars"), global_mean(train))
    return known.select(*KEYS, value.alias("benchmark_bus_mean"))


def user_mean(reviews: DataFrame, train: Split) -> DataFrame:
    known = join_user(reviews.select(*KEYS), _user_stars(train), "left")
    value = F.coalesce(F.col("user_average_stars"), global_mean(train))
    return known.select(*KEYS, value.alias("benchmark_usr_mean"))


def known_stars(reviews: DataFrame, train: Split) -> DataFrame:
    """Every review with the stars and counts known of its business and user."""
    known = join_business(reviews.select(*KEYS), _business_stars(train), "left")
    return join_user(known, _user_stars(train), "left")


def _fallback(train: Split) -> Column:
    return first_positive(
        F.col("bus_stars"), F.col("user_average_stars"), otherwise=global_mean(train)
    )


def business_user_mean(reviews: DataFrame, train: Split) -> DataFrame:
    """Business mean, else user mean, else global mean."""
    value = _fallback(train).alias("benchmark_bus_usr_mean")
    return known_stars(reviews, train).select(*KEYS, value)


def all_means(reviews: DataFrame, train: Split) -> DataFrame:
    """Business, user and combined mean of every review, from one join per key."""
    mean = global_mean(train)
    return known_stars(reviews, train).select(
        *KEYS,
        F.coalesce("bus_stars", mean).alias("benchmark_bus_mean"),
        F.coalesce("user_average_stars", mean).alias("benchmark_usr_mean"),
        _fallback(train).alias("benchmark_bus_usr_mean"),
    )


def greater_count_mean(reviews: DataFrame, train: Split) -> DataFrame:
    """The mean with more reviews behind it (a tie goes to the business), else the fallback."""
    counts = F.col("bus_review_count"), F.col("user_review_count")
    better = F.when(counts[0] >= counts[1], F.col("bus_stars")).when(
        counts[0] < counts[1], F.col("user_average_stars")
    )
    value = first_positive(better, otherwise=_fallback(train))
    return known_stars(reviews, train).select(
        *KEYS, value.alias("benchmark_grtr_rev_count_mean")
    )


def _shrinkage(n: Column, total: Column, squares: Column) -> list[Column]:
    """``level`` and ``pull`` of a group of users from their counts, sums and squares of stars.

    ``pull`` is the number of reviews at the mean of all that stands for what is known without a
    user's own: the variance within users by that between them, from the usual table of mean
    squares. It is NULL if users do not differ beyond chance; then all have the common mean.
    """
    rows, users = F.sum(n), F.count("*")
    level = F.sum(total) / rows
    between = F.sum(total * total / n) - F.sum(total) * level
    within = (F.sum(squares) - F.sum(total * total / n)) / F.nullif(rows - users, F.lit(0))
    size = (rows - F.sum(n * n) / rows) / F.nullif(users - 1, F.lit(0))
    spread = (between / F.nullif(users - 1, F.lit(0)) - within) / size
    return [level.alias("level"), F.when(spread > 0, within / spread).alias("pull")]


def _user_sums(reviews: DataFrame, *more: str) -> DataFrame:
    stars = F.col("rev_stars").cast("double")
    return reviews.where("rev_stars IS NOT NULL").groupBy("user_id", *more).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(stars).alias("total"),
        F.sum(stars * stars).alias("squares"),
    )


def _shrunk() -> Column:
    """The mean of a user's ``n`` reviews and of ``pull`` reviews at the common mean."""
    weighed = (F.coalesce("total", F.lit(0.0)) + F.col("pull") * F.col("level")) / (
        F.coalesce("n", F.lit(0.0)) + F.col("pull")
    )
    return F.coalesce(weighed, F.col("level"))


def weighted_user_mean(reviews: DataFrame, train: Split) -> DataFrame:
    """The mean of a user's training stars, drawn to the common mean the more the fewer they are.

    Stars are summed per user before they are shuffled; the variances are sums over users, one row.
    """
    sums = stage(_user_sums(train.review), "user-sums")
    found = F.struct(*_shrinkage(F.col("n"), F.col("total"), F.col("squares")))
    parts = sums.agg(found).scalar()
    known = join_user(reviews.select(*KEYS), sums, "left").withColumns(
        {"level": parts["level"], "pull": parts["pull"]}
    )
    return known.select(*KEYS, _shrunk().alias("benchmark_usr_wtd_mean"))


def cross_validate_weighted_user_mean(
    df: DataFrame, folds: int = 5, share: float = 0.15
) -> DataFrame:
    """Hold-out size and RMSE of the weighted mean, fitted for each fold without its hold-out.

    The rows are read once: sums per user less those of the user's held rows are the training sums,
    and the error of a fold follows from the sums of the held rows.
    """
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    out = F.filter(every, lambda fold: held_out(F.col("review_id"), fold, share))
    stars = F.col("rev_stars").cast("double")
    # Fold -1 counts all rows.
    sums = stage(
        df.where("rev_stars IS NOT NULL")
        .select("user_id", stars.alias("y"), F.explode(F.concat(F.array(F.lit(-1)), out)).alias("fold"))
        .groupBy("user_id", "fold")
        .agg(
            F.count("*").cast("double").alias("n"),
            F.sum("y").alias("total"),
            F.sum(F.col("y") * F.col("y")).alias("squares"),
        ),
        "user-fold-sums",
    )
    names = ["n", "total", "squares"]
    whole = sums.where("fold < 0").select("user_id", *names, F.explode(every).alias("fold"))
    held = sums.where("fold >= 0").select("user_id", "fold", *(F.col(n).alias(f"held_{n}") for n in names))
    both = whole.join(held, ["user_id", "fold"], "left").select(
        "fold",
        *((F.col(n) - F.coalesce(f"held_{n}", F.lit(0.0))).alias(n) for n in names),
        *(F.coalesce(f"held_{n}", F.lit(0.0)).alias(f"held_{n}") for n in names),
    )
    both = stage(both, "user-fold-training")
    parts = (
        both.where("n > 0")
        .groupBy("fold")
        .agg(*_shrinkage(F.col("n"), F.col("total"), F.col("squares")))
    )
    guess = both.where("held_n > 0").join(F.broadcast(parts), "fold").withColumn("p", _shrunk())
    error = F.col("held_squares") - 2 * F.col("p") * F.col("held_total") + F.col("held_n") * F.col("p") ** 2
    return guess.groupBy("fold").agg(
        F.sum("held_n").cast("bigint").alias("n"),
        F.sqrt(F.greatest(F.sum(error), F.lit(0.0)) / F.sum("held_n")).alias("rmse"),
    )


def constant(reviews: DataFrame, stars: float = CONSTANT_STARS) -> DataFrame:
    return reviews.select(*KEYS, F.lit(float(stars)).alias("benchmark_constant"))
