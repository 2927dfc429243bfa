from __future__ import annotations

from conftest import values
from stargauge.operators import dimensions as dims
from stargauge.operators.features import business_category_scores

BUSINESS = "business_id string, bus_categories array<string>, bus_review_count int, bus_stars double"


def business(spark, *rows):
    return spark.createDataFrame(list(rows), BUSINESS)


def test_repeated_category_counts_twice(spark):
    known = business(spark, ("1", ["a", "a"], 9, 4.0), ("2", ["b"], 9, 2.0))
    reviews = spark.createDataFrame(
        [("u", "1", 5), ("u", "2", 1), ("x", "1", 1)],
        "user_id string, business_id string, rev_stars int",
    )
    users = spark.createDataFrame([("u",)], "user_id string")
    averages = dims.category_averages_from_reviews(reviews, known, users)
    assert values(averages) == [("a", 2, 5.0), ("b", 1, 1.0)]


def test_category_cut_breaks_ties_by_name(spark):
    known = business(spark, ("1", ["c", "b", "a"], 9, 4.0))
    assert values(dims.category_vocabulary(known, 2), "category") == [("a",), ("b",)]


def test_business_categories_need_three_rated_businesses(spark):
    known = business(
        spark,
        ("1", ["a", "b"], 4, 3.0),
        ("2", ["a", "b"], 5, 4.0),
        ("3", ["a"], 6, 5.0),
        ("4", ["b"], 3, 1.0),
        ("5", ["b"], 9, None),
    )
    assert values(dims.category_averages_from_businesses(known)) == [("a", 3.0, 4.0)]


def test_empty_list_is_counted_without_stars(spark):
    known = business(
        spark,
        ("1", [], 9, 4.0),
        ("2", [], 9, 2.0),
        ("3", ["a", "b"], 9, 3.0),
        ("4", ["b", "a"], 9, 1.0),
        ("5", ["a", "b"], 4, 5.0),
        ("6", None, 9, 5.0),
    )
    assert values(dims.grouped_category_averages(known)) == [
        (["a", "b"], 1, 3.0),
        (["b", "a"], 1, 1.0),
        ([], 2, 0.0),
    ]


def test_names_skip_null(spark):
    known = spark.createDataFrame(
        [("A", 4.0), ("A", 1.0), (None, 5.0)], "bus_name string, bus_stars double"
    )
    assert values(dims.name_averages(known)) == [("A", 2, 5.0, 2.5)]


def test_scores_average_the_known_categories(spark):
    known = business(
        spark,
        ("1", ["a", "b", "x"], 1, None),
        ("2", ["x"], 1, None),
        ("3", [], 1, None),
        ("4", ["a", "a", "b"], 1, None),
    )
    averages = spark.createDataFrame(
        [("a", 2.0), ("b", 5.0)], "category string, cat_avg_stars double"
    )
    scored = business_category_scores(known, mean=averages)
    assert values(scored) == [("1", 3.5), ("2", None), ("4", 3.0)]


def test_first_rows_and_best_candidate(spark):
    numbers = spark.range(100, numPartitions=10).withColumnRenamed("id", "n")
    assert values(dims.first_rows(numbers, ["n"], 3, groups=4)) == [(0,), (1,), (2,)]
    scores = spark.createDataFrame([("a", 1.0), ("c", 2.0), ("b", 2.0)], "f string, s double")
    assert dims.best_candidate(scores, "s", "f").first()["f"] == "c"
