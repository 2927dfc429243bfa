"""Cleaning, derived columns, pruning, renaming and typing of the raw entities."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.functions.numeric import fill, round_coordinate
from stargauge.functions.text import zip_code
from stargauge.schemas import KEYS

# Column prefixes, floors below which a user value counts as bad, unused columns.
PREFIXES = {"review": "rev_", "business": "bus_", "user": "user_", "checkin": "chk_"}
MIN_AVERAGE_STARS = 1
MIN_REVIEW_COUNT = 1
UNUSED = {
    ("train", "review"): ("type", "date", "text"),
    ("train", "business"): ("type", "full_address", "neighborhoods", "city"),
    ("train", "user"): ("type",),
    ("train", "checkin"): ("type",),
    ("test", "review"): ("type", "date", "text"),
    ("test", "business"): ("type", "full_address", "city"),
    ("test", "user"): ("type",),
    ("test", "checkin"): ("type",),
}


def mean_of(df: DataFrame, column: str) -> Column:
    """The mean as a one-row subquery, usable as a value in any other frame."""
    return df.agg(F.avg(column)).scalar()


def raise_low(df: DataFrame, column: str, floor: float, replacement: Column) -> DataFrame:
    """Replace values below ``floor``; NULL and the other columns stay as they are."""
    value = F.col(column)
    return df.withColumn(
        column, F.when(value < floor, replacement).otherwise(value.cast("double"))
    )


def fill_null(df: DataFrame, column: str, replacement: Column | float) -> DataFrame:
    return df.withColumn(column, fill(F.col(column), replacement))


def prune(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def pick(df: DataFrame, labels: Iterable[str]) -> DataFrame:
    return df.select(*labels)


def prefix_columns(df: DataFrame, prefix: str, keep: Iterable[str] = KEYS) -> DataFrame:
    """Prefix every column but the ids."""
    kept = set(keep)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in kept})


def narrow_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def derive_business(business: DataFrame) -> DataFrame:
    """Zip code and rounded coordinates."""
    return business.withColumns(
        {
            "zip_code": zip_code(F.col("full_address")),
            "longitude_rounded2": round_coordinate(F.col("longitude")),
            "latitude_rounded2": round_coordinate(F.col("latitude")),
        }
    )


def clean_train_users(train_users: DataFrame) -> DataFrame:
    mean = mean_of(train_users, "average_stars")
    return raise_low(train_users, "average_stars", MIN_AVERAGE_STARS, mean)


def clean_test_users(test_users: DataFrame, train_users: DataFrame) -> DataFrame:
    mean = mean_of(train_users, "review_count")
    return raise_low(test_users, "review_count", MIN_REVIEW_COUNT, mean)


def clean_splits(train: Split, test: Split) -> tuple[Split, Split]:
    """Clean, derive, prune and rename both splits."""
    entities = {
        ("train", "review"): train.review,
        ("train", "business"): derive_business(train.business),
        ("train", "user"): clean_train_users(train.user),
        ("train", "checkin"): train.checkin,
        ("test", "review"): test.review,
        ("test", "business"): derive_business(test.business),
        ("test", "user"): clean_test_users(test.user, train.user),
        ("test", "checkin"): test.checkin,
    }
    ready = {
        (split, entity): prefix_columns(prune(df, UNUSED[split, entity]), PREFIXES[entity])
        for (split, entity), df in entities.items()
    }
    return (
        Split(**{entity: ready["train", entity] for entity in PREFIXES}),
        Split(**{entity: ready["test", entity] for entity in PREFIXES}),
    )


def last_per_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` of every key.

    ``max_by`` aggregates before the shuffle, so a key that holds most rows sends one row per
    input partition.
    """
    last = F.max_by(F.struct(*df.columns), F.col(sequence)).alias("last")
    return df.groupBy(key).agg(last).select("last.*")


def impute_user_average(df: DataFrame) -> DataFrame:
    """Use the average computed from reviews where the user record has none."""
    return fill_null(df, "user_average_stars", F.col("calc_user_avg_stars"))
