"""Fixed schemas of every input, so that no scan has to infer one."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("review_id", "user_id", "business_id")

VOTES = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("funny", "useful", "cool")]
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REVIEW = _struct(
    review_id=T.StringType(),
    user_id=T.StringType(),
    business_id=T.StringType(),
    stars=T.LongType(),
    text=T.StringType(),
    date=T.DateType(),
    votes=VOTES,
    type=T.StringType(),
)

BUSINESS = _struct(
    business_id=T.StringType(),
    name=T.StringType(),
    categories=T.ArrayType(T.StringType()),
    full_address=T.StringType(),
    city=T.StringType(),
    neighborhoods=T.ArrayType(T.StringType()),
    longitude=T.DoubleType(),
    latitude=T.DoubleType(),
    open=T.BooleanType(),
    review_count=T.LongType(),
    stars=T.DoubleType(),
    type=T.StringType(),
)

USER = _struct(
    user_id=T.StringType(),
    name=T.StringType(),
    review_count=T.LongType(),
    average_stars=T.DoubleType(),
    votes=VOTES,
    type=T.StringType(),
)

# A map, because inference would turn every check-in slot into a struct field.
CHECKIN = _struct(
    business_id=T.StringType(),
    checkin_info=T.MapType(T.StringType(), T.LongType()),
    type=T.StringType(),
)

ENTITIES = {"review": REVIEW, "business": BUSINESS, "user": USER, "checkin": CHECKIN}

ID_LOOKUP = "user_id string, business_id string, RecommendationId bigint"
LEXICON = "term string, score int"
REVIEW_CATEGORY_AVERAGES = "category string, cat_count bigint, cat_avg_stars double"
BUSINESS_CATEGORY_AVERAGES = "category string, cat_tot_count double, cat_avg_stars double"
GROUPED_CATEGORY_AVERAGES = (
    "bus_categories array<string>, cat_counts bigint, cat_avg_stars double"
)
GROUPED_BUSINESSES = "business_id string, grp_cat_counts bigint, grp_cat_avg_stars double"
NAME_AVERAGES = (
    "bus_name string, bus_name_counts bigint, total_stars double, bus_name_avg double"
)
