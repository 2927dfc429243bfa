"""Named review subsets by review counts and missing values, as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.operators.cleaning import fill_null
from stargauge.operators.features import CATEGORY_FILL, GROUPED_FILL
from stargauge.operators.joins import (
    attach_names,
    group_businesses,
    join_business,
    join_user,
    with_checkins,
)
from stargauge.sources.staging import stage

# Default outlier bounds.
MAX_BUSINESS_REVIEWS = 450
MAX_CHECKINS = 700

c = F.col


@dataclass(frozen=True)
class Subset:
    """Rows of a source frame that meet a condition; then NULLs filled, columns dropped."""

    source: str
    where: Callable[[], Column] | None = None
    fills: dict[str, float] = field(default_factory=dict)
    drop: tuple[str, ...] = ()


def outliers_out(
    max_reviews: int = MAX_BUSINESS_REVIEWS, max_checkins: int = MAX_CHECKINS
) -> Column:
    return (c("bus_review_count") < max_reviews) & (c("calc_total_checkins") < max_checkins)


def name_count_between(low: int, high: int) -> Column:
    """``low <= count < high``."""
    return (c("bus_name_counts") >= low) & (c("bus_name_counts") < high)


def counts_between(bus_low: int, user_low: int, bus_high: int, user_high: int) -> Column:
    """Both counts reach the lower bounds, and one of them stays below its upper bound."""
    enough = (c("bus_review_count") >= bus_low) & (c("user_review_count") >= user_low)
    return enough & ((c("user_review_count") < user_high) | (c("bus_review_count") < bus_high))


def _no_bus_stars() -> Column:
    return c("bus_stars").isNull()


def _no_user_average() -> Column:
    return c("user_average_stars").isNull()


def _no_user_record() -> Column:
    return _no_user_average() & c("user_review_count").isNull()


def _few_grouped() -> Column:
    return (c("grp_cat_counts") < 4) | c("grp_cat_counts").isNull()


def _few_named() -> Column:
    return c("bus_name_counts").isNull() | (c("bus_name_counts") < 2)


def _cat_avg() -> Column:
    return _few_grouped() & _few_named()


def _cat_avg_test() -> Column:
    return _cat_avg() & c("bus_review_count").isNotNull()


def _grp_cat_avg() -> Column:
    return (c("grp_cat_counts") > 3) & c("bus_name_counts").isNull()


def _all_20() -> Column:
    return (c("bus_review_count") >= 20) & (c("user_review_count") >= 20)


def _all_8_13() -> Column:
    return counts_between(8, 13, 20, 20)


def _all_5_8() -> Column:
    return counts_between(5, 8, 10, 15)


def _all_1_5() -> Column:
    return counts_between(1, 5, 8, 10)


def _names_1_test() -> Column:
    return _no_bus_stars() & (c("bus_name_counts") == 1)


def _names_more_test() -> Column:
    return _no_bus_stars() & (c("bus_name_counts") > 1)


def _rated_user() -> Column:
    return (c("user_average_stars") > 0) & (c("user_review_count") >= 5)


SUBSETS: dict[str, Subset] = {
    "outliers_out": Subset("train", outliers_out),
    "closed": Subset("train_business", lambda: ~c("bus_open")),
    "open": Subset("train_business", lambda: c("bus_open")),
    "names_1_train": Subset("train", lambda: c("bus_name_counts") == 2),
    "names_1_test": Subset("master", _names_1_test),
    "names_more_train": Subset("train", lambda: c("bus_name_counts") > 2),
    "names_more_test": Subset("master", _names_more_test),
    "names_2_to_5": Subset("train", lambda: name_count_between(3, 6)),
    "grp_cat_avg_train": Subset("train", _grp_cat_avg),
    "grp_cat_avg_test": Subset("master", _grp_cat_avg),
    "cat_avg_train": Subset("train", _cat_avg),
    "cat_avg_test": Subset("master", _cat_avg_test),
    "cat_avg_cold_train": Subset("train", lambda: _cat_avg() & (c("bus_review_count") < 240)),
    "cat_avg_cold_test": Subset(
        "master",
        lambda: _cat_avg_test()
        & _no_user_average()
        & _no_bus_stars()
        & c("bus_name_counts").isNull(),
    ),
    "all_20_train": Subset("train", _all_20),
    "all_20_test": Subset("test", _all_20),
    "all_8_13_train": Subset("train", _all_8_13),
    "all_8_13_test": Subset("test", _all_8_13),
    "all_5_8_train": Subset("train", _all_5_8),
    "all_5_8_test": Subset("test", _all_5_8),
    "all_1_5_train": Subset("train", _all_1_5),
    "all_1_5_test": Subset("test", _all_1_5),
    "all_5_8_names_train": Subset("train", lambda: _all_5_8() & (c("bus_name_counts") > 3)),
    "all_5_8_names_test": Subset(
        "test_dimensions", lambda: _all_5_8() & (c("bus_name_counts") > 1)
    ),
    "all_5_8_grouped_test": Subset(
        "test_dimensions",
        lambda: _all_5_8() & (c("bus_name_counts") == 1) & (c("grp_cat_counts") > 2),
        fills={"grp_cat_avg_stars": GROUPED_FILL},
    ),
    "user_5_train": Subset(
        "train", lambda: c("user_review_count") >= 5, fills={"calc_cat_avg": CATEGORY_FILL}
    ),
    "user_5_test": Subset(
        "master",
        lambda: _rated_user() & _no_bus_stars(),
        fills={"calc_cat_avg": CATEGORY_FILL},
    ),
    "business_5_train": Subset("train", lambda: c("bus_review_count") >= 5),
    "business_5_test": Subset(
        "master",
        lambda: (c("bus_review_count") >= 5) & _no_user_average() & (c("bus_stars") > 0),
    ),
    "names_all_1_train": Subset(
        "train", lambda: (c("bus_name_counts") == 2) & (c("user_review_count") >= 5)
    ),
    "names_all_more_train": Subset(
        "train", lambda: (c("bus_name_counts") > 2) & (c("user_review_count") >= 5)
    ),
    "names_all_1_test": Subset("master", lambda: _names_1_test() & _rated_user()),
    "names_all_more_test": Subset("master", lambda: _names_more_test() & _rated_user()),
    "names_cold_1_test": Subset("master", lambda: _names_1_test() & _no_user_average()),
    "names_cold_more_test": Subset("master", lambda: _names_more_test() & _no_user_average()),
    "business_without_stars": Subset("test_business_train_user"),
    "user_without_average": Subset("train_business_test_user"),
    "neither_known": Subset("test_business_test_user"),
    "no_user_test": Subset(
        "test_any_user", _no_user_record, drop=("user_average_stars", "user_review_count")
    ),
    "no_user_train": Subset(
        "train_any_user", _no_user_average, drop=("user_average_stars", "user_review_count")
    ),
    "no_user_no_stars": Subset(
        "test_any_business",
        lambda: _no_user_record() & _no_bus_stars(),
        drop=("bus_stars", "user_average_stars", "user_review_count"),
    ),
}


class SubsetSources:
    """The frames that subsets are cut from, each built when first asked for.

    ``sets`` has ``train``, ``test`` and ``master`` frames with features, ``dimensions`` has
    ``names`` and ``grouped_categories``. ``train_where`` is a condition that all subsets of the
    training set must meet as well, such as ``outliers_out``.
    """

    def __init__(
        self,
        train: Split,
        test: Split,
        everything: Split,
        sets,
        dimensions,
        train_where: Callable[[], Column] | None = None,
    ) -> None:
        self._train, self._test, self._all = train, test, everything
        self._sets, self._dimensions = sets, dimensions
        self._train_where = train_where

    @property
    def train(self) -> DataFrame:
        train = self._sets.train
        return train.where(self._train_where()) if self._train_where else train

    @property
    def test(self) -> DataFrame:
        return self._sets.test

    @property
    def master(self) -> DataFrame:
        return self._sets.master

    @cached_property
    def train_business(self) -> DataFrame:
        return join_business(self._train.review, self._train.business)

    @cached_property
    def test_dimensions(self) -> DataFrame:
        """The test set with name and category-list averages, attached per business."""
        known = self._dimensions
        business = self._train.business.select("business_id", "bus_name", "bus_categories")
        grouped = group_businesses(business, known.grouped_categories)
        wide = attach_names(business, known.names).join(grouped, "business_id", "left")
        extra = stage(wide.drop("bus_name", "bus_categories"), "test-dimensions")
        return self.test.join(extra, "business_id", "left")

    @cached_property
    def _train_businesses(self) -> DataFrame:
        return self._checked_in(self._train.business)

    @cached_property
    def _test_businesses(self) -> DataFrame:
        return self._checked_in(self._test.business)

    def _checked_in(self, business: DataFrame) -> DataFrame:
        return stage(with_checkins(business, self._all.checkin), "business")

    @cached_property
    def test_business_train_user(self) -> DataFrame:
        business = self._test_businesses
        return join_user(join_business(self._test.review, business), self._train.user)

    @cached_property
    def train_business_test_user(self) -> DataFrame:
        business = self._train_businesses
        return join_user(join_business(self._test.review, business), self._test.user)

    @cached_property
    def test_business_test_user(self) -> DataFrame:
        business = self._test_businesses
        return join_user(join_business(self._test.review, business), self._test.user)

    @cached_property
    def test_any_user(self) -> DataFrame:
        business = self._train_businesses
        return join_business(join_user(self._test.review, self._all.user, "left"), business)

    @cached_property
    def train_any_user(self) -> DataFrame:
        business = self._train_businesses
        return join_user(join_business(self._train.review, business), self._train.user, "left")

    @cached_property
    def test_any_business(self) -> DataFrame:
        business = stage(
            self._all.business.join(self._all.checkin, "business_id", "full"), "business"
        )
        return join_business(
            join_user(self._test.review, self._all.user, "left"), business, "left"
        )


def apply_subset(df: DataFrame, spec: Subset) -> DataFrame:
    rows = df.where(spec.where()) if spec.where else df
    for column, value in spec.fills.items():
        rows = fill_null(rows, column, value)
    return rows.drop(*spec.drop)


def subset(sources: SubsetSources, name: str) -> DataFrame:
    spec = SUBSETS[name]
    return apply_subset(getattr(sources, spec.source), spec)
