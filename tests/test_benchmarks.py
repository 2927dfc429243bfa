from __future__ import annotations

from pyspark.sql import functions as F

from conftest import values
from stargauge.frames import Split
from stargauge.operators import benchmarks as ops
from stargauge.operators import models


def train(spark):
    return Split(
        review=spark.createDataFrame([(1,), (4,)], "rev_stars int"),
        business=spark.createDataFrame(
            [("b", 3.0, 10), ("z", 0.0, 10)],
            "business_id string, bus_stars double, bus_review_count int",
        ),
        user=spark.createDataFrame(
            [("u", 4.0, 10), ("v", 5.0, 11)],
            "user_id string, user_average_stars double, user_review_count int",
        ),
        checkin=spark.range(0),
    )


def reviews(spark):
    return spark.createDataFrame(
        [
            ("both_tie", "u", "b"),
            ("both_user", "v", "b"),
            ("only_business", "?", "b"),
            ("only_user", "u", "?"),
            ("neither", "?", "?"),
            ("zero_business", "u", "z"),
        ],
        "review_id string, user_id string, business_id string",
    )


def scores(df, name):
    return dict(values(df, "review_id", f"benchmark_{name}"))


def test_business_and_user_means(spark):
    by_business = scores(ops.business_mean(reviews(spark), train(spark)), "bus_mean")
    assert by_business["both_tie"] == 3.0
    assert by_business["only_user"] == by_business["neither"] == 2.5
    by_user = scores(ops.user_mean(reviews(spark), train(spark)), "usr_mean")
    assert by_user["both_user"] == 5.0
    assert by_user["only_business"] == 2.5


def test_fallback_chain(spark):
    got = scores(ops.business_user_mean(reviews(spark), train(spark)), "bus_usr_mean")
    assert got == {
        "both_tie": 3.0,
        "both_user": 3.0,
        "only_business": 3.0,
        "only_user": 4.0,
        "neither": 2.5,
        "zero_business": 4.0,
    }


def test_greater_count(spark):
    got = scores(ops.greater_count_mean(reviews(spark), train(spark)), "grtr_rev_count_mean")
    assert got == {
        "both_tie": 3.0,
        "both_user": 5.0,
        "only_business": 3.0,
        "only_user": 4.0,
        "neither": 2.5,
        "zero_business": 4.0,
    }


def rated(spark, n=4000):
    key = F.col("id")
    return spark.range(n).select(
        key.cast("string").alias("review_id"), (key % 5 + 1).alias("rev_stars")
    )


def test_folds_are_repeatable_holdouts_of_about_the_share(spark):
    first = models.with_folds(rated(spark), 3, 0.15)
    assert values(first) == values(models.with_folds(rated(spark).repartition(5), 3, 0.15))
    for row in first.groupBy("fold").count().collect():
        assert 500 < row["count"] < 700


def test_training_mean_equals_the_mean_outside_the_holdout(spark):
    rows = rated(spark)
    got = {r["fold"]: (r["n"], r["rmse"]) for r in
           models.cross_validate_training_mean(rows, 2, 0.15).collect()}
    held = models.with_folds(rows, 2, 0.15)
    for fold in (0, 1):
        out = [r["rev_stars"] for r in held.where(F.col("fold") == fold).collect()]
        every = [r["rev_stars"] for r in rows.collect()]
        mean = (sum(every) - sum(out)) / (len(every) - len(out))
        rmse = (sum((y - mean) ** 2 for y in out) / len(out)) ** 0.5
        assert got[fold][0] == len(out)
        assert abs(got[fold][1] - rmse) < 1e-9


def test_training_mean_of_equal_labels_is_exact(spark):
    same = rated(spark, 200).withColumn("rev_stars", F.lit(3.3))
    got = models.cross_validate_training_mean(same, 3, 0.2).collect()
    assert len(got) == 3
    assert all(row["rmse"] < 1e-6 for row in got)


def shrunk_means(stars):
    """Users' means drawn to the common one, by the table of mean squares, plainly."""
    users = {}
    for user, value in stars:
        users.setdefault(user, []).append(value)
    n, m = len(stars), len(users)
    level = sum(value for _, value in stars) / n
    between = sum(len(v) * (sum(v) / len(v) - level) ** 2 for v in users.values()) / (m - 1)
    within = sum((x - sum(v) / len(v)) ** 2 for v in users.values() for x in v) / (n - m)
    size = (n - sum(len(v) ** 2 for v in users.values()) / n) / (m - 1)
    spread = (between - within) / size
    if spread <= 0:
        return {user: level for user in users}, level
    pull = within / spread
    return {u: (sum(v) + pull * level) / (len(v) + pull) for u, v in users.items()}, level


STARS = [("a", 5), ("a", 5), ("a", 4), ("b", 1), ("b", 2), ("c", 3), ("d", 5), ("d", 3), ("d", 4), ("d", 5)]


def weighted(spark, stars):
    review = spark.createDataFrame(stars, "user_id string, rev_stars int")
    asked = [("1", "a", "x"), ("2", "b", "x"), ("3", "c", "x"), ("4", "?", "x"), ("5", None, "x")]
    rows = spark.createDataFrame(asked, "review_id string, user_id string, business_id string")
    split = Split(review=review, business=spark.range(0), user=spark.range(0), checkin=spark.range(0))
    return dict(values(ops.weighted_user_mean(rows, split), "review_id", "benchmark_usr_wtd_mean"))


def test_weighted_user_mean(spark):
    means, level = shrunk_means(STARS)
    found = weighted(spark, STARS)
    for key, user in (("1", "a"), ("2", "b"), ("3", "c")):
        assert abs(found[key] - means[user]) < 1e-12
    assert abs(found["4"] - level) < 1e-12 and abs(found["5"] - level) < 1e-12
    # The fewer the reviews, the nearer to the common mean.
    own = {"a": 14 / 3, "b": 1.5}
    assert all(abs(means[u] - level) < abs(own[u] - level) for u in own)


def test_weighted_user_mean_without_a_difference_between_users(spark):
    stars = [("a", 1), ("a", 5), ("b", 1), ("b", 5)]
    assert set(weighted(spark, stars).values()) == {3.0}


def test_weighted_user_mean_of_single_reviews(spark):
    """One review a user: what differs within users cannot be told; all have the common mean."""
    assert set(weighted(spark, [("a", 1), ("b", 5)]).values()) == {3.0}
