from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from conftest import values
from stargauge.frames import Split
from stargauge.operators import joins as ops
from stargauge.operators import sentiment
from stargauge.operators.benchmarks import known_stars
from stargauge.operators.features import computed_user_averages

REVIEW = "review_id string, user_id string, business_id string"


def reviews(spark, *rows):
    return spark.createDataFrame(list(rows), REVIEW)


def test_master_keeps_every_review_and_checkins_without_business(spark):
    everything = Split(
        business=spark.createDataFrame([("b", 3.0)], "business_id string, bus_stars double"),
        user=spark.createDataFrame([("u", 4.0)], "user_id string, user_average_stars double"),
        checkin=spark.createDataFrame([("x", 7)], "business_id string, total int"),
    )
    master = ops.master_set(
        reviews(spark, ("1", "u", "b"), ("2", "v", "x"), ("3", "v", "y")), everything
    )
    assert values(master, "review_id", "bus_stars", "user_average_stars", "total") == [
        ("1", 3.0, 4.0, None),
        ("2", None, None, 7),
        ("3", None, None, None),
    ]


def test_repeated_pairs_do_not_multiply_reviews(spark):
    same = reviews(spark, ("1", "u", "b"), ("2", "u", "b"), ("3", "u", "c"))
    pairs = spark.createDataFrame(
        [("u", "b", 9), ("u", "b", 8)], "user_id string, business_id string, number int"
    )
    joined = ops.join_pairs(same, pairs)
    assert values(joined, "review_id", "number") == [("1", 8), ("2", 8), ("3", None)]


def test_reattach_brings_back_unmatched_reviews(spark):
    every = reviews(spark, ("1", "u", "b"), ("2", "u", "c"))
    business = spark.createDataFrame([("b", 2.5)], "business_id string, bus_stars double")
    whole = ops.reattach(ops.join_business(every, business), every)
    assert values(whole, "review_id", "bus_stars") == [("1", 2.5), ("2", None)]


def test_missing_users(spark):
    train = spark.createDataFrame(
        [("1", "u", 5), ("2", "u", 2), ("3", "v", 1), ("4", "w", 4), ("5", "x", 3)],
        "review_id string, user_id string, rev_stars int",
    )
    # u has no record, v a record without average, w a known one, x wrote no test review.
    test = reviews(spark, ("t", "u", "b"), ("s", "u", "b"), ("q", "v", "b"), ("p", "w", "b"))
    users = spark.createDataFrame(
        [("v", None), ("w", 4.0)], "user_id string, user_average_stars double"
    )
    rows = ops.missing_user_reviews(train, test, users)
    assert values(rows, "review_id") == [("1",), ("2",), ("3",)]
    averages = computed_user_averages(train, test, users)
    assert values(averages) == [("u", 2.0, 3.5), ("v", 1.0, 1.0)]


def test_names_outer_appends_unseen_names_and_null_names_stay_alone(spark):
    df = spark.createDataFrame([("1", "A"), ("2", None)], "review_id string, bus_name string")
    names = spark.createDataFrame([("A", 2), ("B", 3)], "bus_name string, bus_name_counts int")
    outer = ops.attach_names(df, names, "outer")
    assert values(outer, "review_id", "bus_name", "bus_name_counts") == [
        ("1", "A", 2),
        ("2", None, None),
        (None, "B", 3),
    ]
    assert ops.attach_names(df, names, "left").count() == 2
    assert ops.attach_names(df, names, "inner").count() == 1


def test_category_lists_match_in_order_only(spark):
    business = spark.createDataFrame(
        [("1", ["a", "b"]), ("2", ["b", "a"]), ("3", [])],
        "business_id string, bus_categories array<string>",
    )
    grouped = spark.createDataFrame(
        [(["a", "b"], 4, 3.0), ([], 5, 0.0)],
        "bus_categories array<string>, cat_counts int, cat_avg_stars double",
    )
    assert values(ops.group_businesses(business, grouped)) == [
        ("1", 4, 3.0),
        ("2", None, None),
        ("3", 5, 0.0),
    ]


def test_combine_fills_absent_columns_with_null(spark):
    def split(**columns):
        business = spark.createDataFrame(
            [tuple(columns.values())], ", ".join(f"{name} double" for name in columns)
        )
        plain = spark.range(1)
        return Split(business=business, user=plain, checkin=plain)

    both = ops.combine(split(n=1.0, bus_stars=2.0), split(n=3.0))
    assert values(both.business, "n", "bus_stars") == [(1.0, 2.0), (3.0, None)]
    assert both.user.count() == 2, "a bag union keeps repeats"


@contextmanager
def settings(spark, **values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SMALL_SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_hot_keys_are_split_at_runtime(spark, warehouse):
    """A business and a user that hold a third of the reviews, without broadcasts."""
    with settings(spark, **NO_BROADCAST, **SMALL_SKEW):
        n = F.col("id")
        hot = (n % 3) == 0
        many = spark.range(0, 60_000, numPartitions=8).select(
            n.cast("string").alias("review_id"),
            F.when(hot, F.lit(1)).otherwise(n % 130).alias("user_id"),
            F.when(hot, F.lit(1)).otherwise(n % 170).alias("business_id"),
        )
        train = warehouse.train
        joined = ops.modelling_set(
            many, train.business, train.user, warehouse.everything.checkin
        ).select("review_id", "bus_stars", "user_average_stars", "chk_checkin_info")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("SortMergeJoin(skew=true)") == 2


def test_a_word_in_a_third_of_the_reviews_is_split(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "fits_broadcast", lambda df: False)
    with settings(spark, **NO_BROADCAST, **SMALL_SKEW):
        n = F.col("id")
        text = F.concat_ws(" ", F.when(n % 3 == 0, F.lit("good")), F.concat(F.lit("w"), n % 9000))
        texts = spark.range(0, 60_000, numPartitions=8).select(
            n.alias("review_id"), text.alias("text")
        )
        lexicon = spark.createDataFrame([("good", 3), ("w7", 1)], "term string, score int")
        scored = sentiment.sentiment_scores(texts, lexicon)
        total = scored.groupBy().sum("score").collect()[0][0]
        assert total == 3 * 20_000 + 7
        scored.collect()
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "build",
    [
        lambda w: w.sets.train,
        lambda w: w.sets.test,
        lambda w: w.sets.master,
        lambda w: ops.master_set(w.test.review, w.everything),
        lambda w: ops.missing_user_reviews(w.train.review, w.test.review, w.train.user),
        lambda w: ops.attach_recommendation_ids(w.test.review, w.id_lookup),
        lambda w: known_stars(w.test.review, w.train),
    ],
)
def test_both_sides_of_every_review_join_are_plain_shuffles(spark, warehouse, build):
    with settings(spark, **NO_BROADCAST):
        plan = build(warehouse).select("*")._jdf.queryExecution().executedPlan().toString()
    joins = plan.count("SortMergeJoin [")
    assert joins >= 2
    assert plan.count("Exchange hashpartitioning") == 2 * joins
