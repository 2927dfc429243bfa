"""Every named subset, and the outlier filter with a bound that cuts rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge.operators import dimensions as dims
from stargauge.operators.subsets import (
    SUBSETS,
    Subset,
    SubsetSources,
    apply_subset,
    outliers_out,
    subset,
)
from stargauge.queries.columns import r6
from stargauge.queries.registry import query
from stargauge.sources.warehouse import Warehouse

# The output of a subset, by its source frame: columns as they are, and rounded columns.
_PLAIN = {
    "train": [
        "review_id", "rev_stars", "bus_stars", "bus_review_count", "bus_name_counts",
        "grp_cat_counts", "calc_total_checkins",
    ],
    "test": ["review_id", "bus_stars", "bus_review_count", "calc_total_checkins"],
    "master": [
        "review_id", "bus_stars", "bus_review_count", "bus_name_counts", "grp_cat_counts",
        "calc_total_checkins",
    ],
    "test_dimensions": [
        "review_id", "bus_stars", "bus_review_count", "bus_name_counts", "grp_cat_counts",
    ],
    "train_business": ["review_id", "rev_stars", "bus_stars", "bus_open"],
    "test_business_train_user": ["review_id", "bus_review_count", "bus_zip_code"],
    "train_business_test_user": ["review_id", "bus_stars", "bus_review_count"],
    "test_business_test_user": ["review_id", "bus_review_count", "bus_zip_code"],
    "test_any_user": ["review_id", "bus_stars", "bus_review_count"],
    "train_any_user": ["review_id", "rev_stars", "bus_stars"],
    "test_any_business": ["review_id", "bus_review_count", "bus_zip_code"],
}
_ROUNDED = {
    "train": ["user_average_stars", "user_review_count", "calc_cat_avg", "bus_name_avg"],
    "test": ["user_average_stars", "user_review_count", "calc_cat_avg"],
    "master": ["user_average_stars", "user_review_count", "calc_cat_avg", "calc_user_avg_stars"],
    "test_dimensions": ["user_average_stars", "user_review_count", "grp_cat_avg_stars"],
    "test_business_train_user": ["user_average_stars", "user_review_count"],
    "train_business_test_user": ["user_review_count"],
    "test_business_test_user": ["user_review_count"],
}

_FROM = {
    "train": "v_train_set",
    "test": "v_test_set",
    "master": "v_master_set",
    "test_dimensions": """(SELECT * FROM v_test_set LEFT JOIN v_names USING (bus_name)
        LEFT JOIN v_grouped_businesses USING (business_id))""",
    "train_business": "v_train_reviews JOIN v_train_business USING (business_id)",
    "test_business_train_user": """v_test_reviews JOIN v_test_business USING (business_id)
        JOIN v_train_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "train_business_test_user": """v_test_reviews JOIN v_train_business USING (business_id)
        JOIN v_test_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "test_business_test_user": """v_test_reviews JOIN v_test_business USING (business_id)
        JOIN v_test_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "test_any_user": """v_test_reviews LEFT JOIN v_all_user USING (user_id)
        JOIN v_train_business USING (business_id) LEFT JOIN v_checkin USING (business_id)""",
    "train_any_user": """v_train_reviews JOIN v_train_business USING (business_id)
        LEFT JOIN v_train_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "test_any_business": """v_test_reviews LEFT JOIN v_all_user USING (user_id)
        LEFT JOIN v_all_business USING (business_id)
        LEFT JOIN v_checkin USING (business_id)""",
}

_FEW = """(grp_cat_counts < 4 OR grp_cat_counts IS NULL)
          AND (bus_name_counts IS NULL OR bus_name_counts < 2)"""
_GRP = "grp_cat_counts > 3 AND bus_name_counts IS NULL"
_20 = "bus_review_count >= 20 AND user_review_count >= 20"
_8_13 = """bus_review_count >= 8 AND user_review_count >= 13
           AND (user_review_count < 20 OR bus_review_count < 20)"""
_5_8 = """bus_review_count >= 5 AND user_review_count >= 8
          AND (user_review_count < 15 OR bus_review_count < 10)"""
_1_5 = """bus_review_count >= 1 AND user_review_count >= 5
          AND (user_review_count < 10 OR bus_review_count < 8)"""
_NAMES_1 = "bus_stars IS NULL AND bus_name_counts = 1"
_NAMES_MORE = "bus_stars IS NULL AND bus_name_counts > 1"
_RATED = "user_average_stars > 0 AND user_review_count >= 5"
_NO_USER = "user_average_stars IS NULL AND user_review_count IS NULL"

# Query name, subset, SQL condition.
_QUERIES = [
    ("f1_outliers_out", "outliers_out", "bus_review_count < 450 AND calc_total_checkins < 700"),
    ("f2_closed", "closed", "NOT bus_open"),
    ("f2_open", "open", "bus_open"),
    ("f3_names_1_train", "names_1_train", "bus_name_counts = 2"),
    ("f3_names_1_test", "names_1_test", _NAMES_1),
    ("f4_names_more_train", "names_more_train", "bus_name_counts > 2"),
    ("f4_names_more_test", "names_more_test", _NAMES_MORE),
    ("f5_names_2_to_5", "names_2_to_5", "bus_name_counts BETWEEN 3 AND 5"),
    ("f6_grp_cat_avg_train", "grp_cat_avg_train", _GRP),
    ("f6_grp_cat_avg_test", "grp_cat_avg_test", _GRP),
    ("f7_cat_avg_train", "cat_avg_train", _FEW),
    ("f7_cat_avg_test", "cat_avg_test", f"{_FEW} AND bus_review_count IS NOT NULL"),
    ("f8_cat_avg_cold_train", "cat_avg_cold_train", f"{_FEW} AND bus_review_count < 240"),
    (
        "f8_cat_avg_cold_test",
        "cat_avg_cold_test",
        f"{_FEW} AND bus_review_count IS NOT NULL AND user_average_stars IS NULL "
        "AND bus_stars IS NULL AND bus_name_counts IS NULL",
    ),
    ("f9_all_20_train", "all_20_train", _20),
    ("f9_all_20_test", "all_20_test", _20),
    ("f10_all_8_13_train", "all_8_13_train", _8_13),
    ("f10_all_8_13_test", "all_8_13_test", _8_13),
    ("f11_all_5_8_train", "all_5_8_train", _5_8),
    ("f11_all_5_8_test", "all_5_8_test", _5_8),
    ("f12_all_1_5_train", "all_1_5_train", _1_5),
    ("f12_all_1_5_test", "all_1_5_test", _1_5),
    ("f13_all_5_8_names_train", "all_5_8_names_train", f"{_5_8} AND bus_name_counts > 3"),
    ("f13_all_5_8_names_test", "all_5_8_names_test", f"{_5_8} AND bus_name_counts > 1"),
    (
        "f14_all_5_8_grouped_test",
        "all_5_8_grouped_test",
        f"{_5_8} AND bus_name_counts = 1 AND grp_cat_counts > 2",
    ),
    ("f15_user_5_train", "user_5_train", "user_review_count >= 5"),
    ("f15_user_5_test", "user_5_test", f"{_RATED} AND bus_stars IS NULL"),
    ("f16_business_5_train", "business_5_train", "bus_review_count >= 5"),
    (
        "f16_business_5_test",
        "business_5_test",
        "bus_review_count >= 5 AND user_average_stars IS NULL AND bus_stars > 0",
    ),
    (
        "f17_names_all_1_train",
        "names_all_1_train",
        "bus_name_counts = 2 AND user_review_count >= 5",
    ),
    (
        "f17_names_all_more_train",
        "names_all_more_train",
        "bus_name_counts > 2 AND user_review_count >= 5",
    ),
    ("f17_names_all_1_test", "names_all_1_test", f"{_NAMES_1} AND {_RATED}"),
    ("f17_names_all_more_test", "names_all_more_test", f"{_NAMES_MORE} AND {_RATED}"),
    (
        "f18_names_cold_1_test",
        "names_cold_1_test",
        f"{_NAMES_1} AND user_average_stars IS NULL",
    ),
    (
        "f18_names_cold_more_test",
        "names_cold_more_test",
        f"{_NAMES_MORE} AND user_average_stars IS NULL",
    ),
    ("f19_business_without_stars", "business_without_stars", "TRUE"),
    ("f20_user_without_average", "user_without_average", "TRUE"),
    ("f21_neither_known", "neither_known", "TRUE"),
    ("f22_no_user_test", "no_user_test", _NO_USER),
    ("f22_no_user_train", "no_user_train", "user_average_stars IS NULL"),
    ("f23_no_user_no_stars", "no_user_no_stars", f"{_NO_USER} AND bus_stars IS NULL"),
]


def _columns(source: str) -> list:
    rounded = [r6(name) for name in _ROUNDED.get(source, [])]
    return [F.col(name) for name in _PLAIN[source]] + rounded


def _sql(spec: Subset, condition: str) -> str:
    def rounded(name: str) -> str:
        value = f"coalesce({name}, {spec.fills[name]})" if name in spec.fills else name
        return f"round({value}, 6) AS {name}"

    columns = [*_PLAIN[spec.source], *map(rounded, _ROUNDED.get(spec.source, []))]
    return f"SELECT {', '.join(columns)} FROM {_FROM[spec.source]} WHERE {condition}"


def _register(name: str, subset_name: str, condition: str) -> None:
    spec = SUBSETS[subset_name]

    def run(w: Warehouse) -> DataFrame:
        return subset(w.subset_sources, subset_name).select(*_columns(spec.source))

    query(name, _sql(spec, condition))(run)


for _name, _subset, _condition in _QUERIES:
    _register(_name, _subset, _condition)


_TIGHT = Subset("train", lambda: outliers_out(40, 60))


@query("f1_outliers_out_tight", _sql(_TIGHT, "bus_review_count < 40 AND calc_total_checkins < 60"))
def tight_outliers(w: Warehouse) -> DataFrame:
    return apply_subset(w.sets.train, _TIGHT).select(*_columns("train"))


@query(
    "f11_all_5_8_train_no_outliers",
    _sql(
        SUBSETS["all_5_8_train"],
        f"{_5_8} AND bus_review_count < 40 AND calc_total_checkins < 60",
    ),
)
def no_outliers(w: Warehouse) -> DataFrame:
    sources = SubsetSources(
        w.train, w.test, w.everything, w.sets, w.dimensions, lambda: outliers_out(40, 60)
    )
    return subset(sources, "all_5_8_train").select(*_columns("train"))


@query(
    "f24_rated_businesses",
    """SELECT business_id, bus_review_count, bus_stars FROM v_all_business
       WHERE bus_review_count > 4 AND bus_stars > 0""",
)
def rated(w: Warehouse) -> DataFrame:
    rows = dims.rated_businesses(w.everything.business, dims.MIN_REVIEWS_PER_GROUPED_BUSINESS)
    return rows.select("business_id", "bus_review_count", "bus_stars")
