"""Precompute the average-star dimensions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from stargauge.frames import Split
from stargauge.operators import dimensions as dims
from stargauge.operators.joins import group_businesses
from stargauge.sources import readers
from stargauge.sources.staging import stage_all
from stargauge.sources.writers import write_csv, write_dimension


@dataclass(frozen=True)
class Dimensions:
    """The four dimensions, one row per key each."""

    review_categories: DataFrame
    business_categories: DataFrame
    grouped_categories: DataFrame
    names: DataFrame

    def ready(self) -> Dimensions:
        return self


class StagedDimensions:
    """The four dimensions, each computed and written when first asked for."""

    def __init__(self, train: Split, everything: Split, k: int = dims.TOP_CATEGORIES) -> None:
        self._train, self._all, self._k = train, everything, k
        self._staged: dict[str, DataFrame] = {}

    def _plan(self, name: str) -> DataFrame:
        train, business = self._train, self._all.business
        match name:
            case "review_categories":
                return dims.category_averages_from_reviews(
                    train.review, train.business, train.user, self._k
                )
            case "business_categories":
                return dims.category_averages_from_businesses(business)
            case "grouped_categories":
                return dims.grouped_category_averages(business)
            case _:
                return dims.name_averages(train.business)

    def _stage(self, names: list[str]) -> None:
        missing = [name for name in names if name not in self._staged]
        self._staged |= stage_all({name: self._plan(name) for name in missing})

    def ready(self) -> Dimensions:
        """All four at once."""
        names = [field.name for field in fields(Dimensions)]
        self._stage(names)
        return Dimensions(**{name: self._staged[name] for name in names})

    def _one(self, name: str) -> DataFrame:
        self._stage([name])
        return self._staged[name]

    @property
    def review_categories(self) -> DataFrame:
        return self._one("review_categories")

    @property
    def business_categories(self) -> DataFrame:
        return self._one("business_categories")

    @property
    def grouped_categories(self) -> DataFrame:
        return self._one("grouped_categories")

    @property
    def names(self) -> DataFrame:
        return self._one("names")


def write_dimensions(
    dimensions: Dimensions | StagedDimensions, everything: Split, folder: str
) -> None:
    """Write the files that the dimension readers expect."""
    paths = {name: f"{folder.rstrip('/')}/{file}" for name, file in readers.FILES.items()}
    known = dimensions.ready()
    for field in fields(Dimensions):
        write_dimension(getattr(known, field.name), paths[field.name])
    grouped = group_businesses(everything.business, known.grouped_categories)
    write_csv(grouped, paths["grouped_businesses"])


def read_dimensions(spark: SparkSession, folder: str) -> Dimensions:
    from_reviews, from_businesses, grouped = readers.read_category_averages(spark, folder)
    return Dimensions(
        review_categories=from_reviews,
        business_categories=from_businesses,
        grouped_categories=grouped,
        names=readers.read_name_averages(spark, folder),
    )
