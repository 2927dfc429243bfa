from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import values
from stargauge.functions import numeric, text
from stargauge.operators import cleaning as ops

c = F.col


def one(spark, expression, **row):
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in row.items())
    df = spark.createDataFrame([tuple(value for _, value in row.values())], schema)
    return df.select(expression).first()[0]


@pytest.mark.parametrize(
    ("address", "zip_code"),
    [
        ("1 Main St, Phoenix, AZ 85001", "85001"),
        ("1 Main St, Phoenix, AZ", "Missing"),
        ("AZ1", "Missing"),
        ("abc", "abc"),
        ("", ""),
        (None, None),
    ],
)
def test_zip_code(spark, address, zip_code):
    assert one(spark, text.zip_code(c("a")), a=("string", address)) == zip_code


@pytest.mark.parametrize(
    ("categories", "flat"),
    [(["a", "b"], "-a-b"), (["a"], "-a"), ([], "MISSING")],
)
def test_flat_categories(spark, categories, flat):
    row = {"k": ("array<string>", categories)}
    assert one(spark, text.flat_categories(c("k")), **row) == flat
    listed = one(spark, text.categories_or_missing(c("k")), **row)
    assert listed == (categories or ["MISSING"])


def test_coordinates_round_halves_away_from_zero(spark):
    assert one(spark, numeric.round_coordinate(c("x")), x=("double", 0.125)) == 0.13
    assert one(spark, numeric.round_coordinate(c("x")), x=("double", -0.125)) == -0.13


@pytest.mark.parametrize(
    ("raw", "found"),
    [
        ("good  bad\tgood\n", ["good", "bad", "good"]),
        ("a b　c d", ["a", "b", "c", "d"]),
        ("", []),
        ("   ", []),
        ("Good, good!", ["Good,", "good!"]),
    ],
)
def test_words(spark, raw, found):
    assert one(spark, text.words(c("t")), t=("string", raw)) == found


def test_normalized_words(spark):
    got = one(spark, text.words(c("t"), normalize=True), t=("string", "Good, 'BAD'! -- don't"))
    assert got == ["good", "bad", "don't"]


def test_map_total(spark):
    kind = "map<string,bigint>"
    assert one(spark, numeric.map_total(c("m")), m=(kind, {"a": 2, "b": 3})) == 5
    assert one(spark, numeric.map_total(c("m")), m=(kind, {})) == 0
    assert one(spark, numeric.map_total(c("m")), m=(kind, None)) == 0


def test_clamp(spark):
    for value, bounded in [(0.5, 1.2), (3.0, 3.0), (5.0, 4.8), (None, None)]:
        assert one(spark, numeric.clamp(c("x"), 1.2, 4.8), x=("double", value)) == bounded
        assert one(spark, numeric.clamp(c("x")), x=("double", value)) == value


def test_first_positive_skips_null_and_zero(spark):
    expression = numeric.first_positive(c("a"), c("b"), otherwise=F.lit(9.0))
    for a, b, stars in [(1.0, 2.0, 1.0), (0.0, 2.0, 2.0), (None, 2.0, 2.0), (None, None, 9.0)]:
        assert one(spark, expression, a=("double", a), b=("double", b)) == stars


def test_low_averages_change_only_their_column(spark):
    users = spark.createDataFrame(
        [("u", 5, 0.0), ("v", 0, 4.0), ("w", 7, None)],
        "user_id string, review_count bigint, average_stars double",
    )
    cleaned = ops.clean_train_users(users)
    assert values(cleaned) == [("u", 5, 2.0), ("v", 0, 4.0), ("w", 7, None)]


def test_low_test_counts_take_the_training_mean(spark):
    train = spark.createDataFrame([("a", 4), ("b", 5)], "user_id string, review_count bigint")
    test = spark.createDataFrame([("u", 0), ("v", 3)], "user_id string, review_count bigint")
    assert values(ops.clean_test_users(test, train)) == [("u", 4.5), ("v", 3.0)]


def test_prefixes_leave_the_ids(spark):
    df = spark.createDataFrame([("r", "u", 1)], "review_id string, user_id string, stars int")
    assert ops.prefix_columns(df, "rev_").columns == ["review_id", "user_id", "rev_stars"]


def test_narrow_types(spark):
    df = ops.narrow_types(spark.range(3), {"id": "tinyint"})
    assert df.dtypes == [("id", "tinyint")]


def test_last_row_per_key(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    assert values(ops.last_per_key(df, "k", "n")) == [("a", 3, "y"), ("b", 2, "z")]


def test_user_average_is_imputed_only_where_missing(spark):
    df = spark.createDataFrame(
        [(4.0, 1.0), (None, 2.0), (None, None)],
        "user_average_stars double, calc_user_avg_stars double",
    )
    assert values(ops.impute_user_average(df), "user_average_stars") == [(2.0,), (4.0,), (None,)]
