"""The rating entities as views over the star-schema warehouse tables.

Line items are reviews by the ordering customer of the ordered part: orders before
``TEST_FROM`` are training reviews, later ones test reviews. Parts are businesses, customers
are users, events are check-ins, documents carry review text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stargauge.frames import Split
from stargauge.operators.cleaning import clean_splits
from stargauge.operators.joins import combine
from stargauge.operators.subsets import SubsetSources
from stargauge.plans.dimensions import StagedDimensions
from stargauge.plans.modelling import ReviewSets

TEST_FROM = "2000-01-01"
OLD_TEST_FROM = "1999-07-01"

# Columns the views use; declared, so that opening a table starts no job.
TABLES = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    ),
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "events": "ts timestamp_ntz, user_id bigint, event_type string",
    "documents": "doc_id bigint, text string",
    "benchmark": "item_id bigint, text string",
}

c = F.col


REVIEW = [
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " cast(round(l_extendedprice * 100) AS bigint)) AS review_id",
    "o_custkey AS user_id",
    "l_partkey AS business_id",
    "cast((cast(l_quantity AS int) - 1) % 5 + 1 AS bigint) AS stars",
    "cast(NULL AS string) AS text",
    "cast(o_orderdate AS date) AS date",
    "named_struct('funny', 0L, 'useful', cast(l_linenumber AS bigint), 'cool', 0L) AS votes",
    "'review' AS type",
]

BUSINESS = [
    "p_partkey AS business_id",
    "CASE WHEN p_partkey % 23 = 0 THEN NULL"
    " WHEN p_partkey % 40 = 20 THEN p_name"
    " WHEN p_partkey % 4 = 0 THEN concat('Solo ', p_partkey)"
    " WHEN p_partkey % 4 IN (1, 2) THEN concat('Pair ', p_partkey % 4, ' ', p_partkey div 8)"
    " ELSE p_name END AS name",
    "CASE WHEN p_partkey % 17 = 0 THEN cast(array() AS array<string>)"
    " WHEN p_partkey % 3 = 0 THEN array(p_type, p_brand, split_part(p_name, ' ', 2))"
    " ELSE array(p_type, split_part(p_name, ' ', 2)) END AS categories",
    "concat('St ', p_partkey, ', Phoenix, AZ',"
    " CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat(' ', 85000 + p_partkey % 50) END)"
    " AS full_address",
    "'Phoenix' AS city",
    "cast(array() AS array<string>) AS neighborhoods",
    "-112D + (p_partkey % 1000) / 777D AS longitude",
    "33D + (p_partkey % 1000) / 555D AS latitude",
    "p_partkey % 9 <> 0 AS open",
    "cast(p_size AS bigint) AS review_count",
    "1 + (p_size % 9) * 0.5D AS stars",
    "'business' AS type",
]

# The review count starts at 1 in training and at 0, a bad value, in test.
USER = [
    "c_custkey AS user_id",
    "c_name AS name",
    "cast({first_count} + c_custkey % 40 AS bigint) AS review_count",
    "0.5D + (c_custkey % 46) / 10D AS average_stars",
    "named_struct('funny', 0L, 'useful', c_custkey % 5, 'cool', 0L) AS votes",
    "'user' AS type",
]


class Warehouse:
    """Entity frames over one folder of tables. Frames are lazy unless stated."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(TABLES[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # ---- raw entities ---------------------------------------------------------------------

    def _reviews(self, when: str) -> DataFrame:
        orders = self.table("orders").where(when)
        lines = self.table("lineitem").join(orders, c("l_orderkey") == c("o_orderkey"))
        return lines.selectExpr(*REVIEW)

    def _businesses(self, when: str) -> DataFrame:
        return self.table("part").where(when).selectExpr(*BUSINESS)

    def _users(self, when: str, first_count: int) -> DataFrame:
        columns = [column.format(first_count=first_count) for column in USER]
        return self.table("customer").where(f"c_custkey % 11 <> 0 AND {when}").selectExpr(*columns)

    def _checkins(self, when: str) -> DataFrame:
        # Counted per slot first: what is put together per business is at most one entry per
        # hour and event type.
        slots = (
            self.table("events")
            .where(when)
            .selectExpr("user_id AS business_id", "concat(hour(ts), '-', event_type) AS slot")
            .groupBy("business_id", "slot")
            .agg(F.expr("count(*) AS n"))
        )
        info = F.expr("map_from_entries(collect_list(struct(slot, n))) AS checkin_info")
        return slots.groupBy("business_id").agg(info).withColumn("type", F.lit("checkin"))

    @cached_property
    def raw_train(self) -> Split:
        return Split(
            review=self._reviews(f"o_orderdate < '{TEST_FROM}'"),
            business=self._businesses("p_partkey % 10 <> 0"),
            user=self._users("c_custkey % 7 <> 0", first_count=1),
            checkin=self._checkins("user_id % 10 <> 0"),
        )

    def _unlabelled(self, split: Split) -> Split:
        return Split(
            review=split.review.drop("stars", "text", "date", "votes"),
            business=split.business.drop("stars"),
            user=split.user.drop("average_stars", "votes"),
            checkin=split.checkin,
        )

    @cached_property
    def raw_test(self) -> Split:
        return self._unlabelled(
            Split(
                review=self._reviews(f"o_orderdate >= '{TEST_FROM}'"),
                business=self._businesses("p_partkey % 10 = 0"),
                user=self._users("c_custkey % 7 = 0", first_count=0),
                checkin=self._checkins("user_id % 10 = 0"),
            )
        )

    @cached_property
    def raw_old_test(self) -> Split:
        """An earlier hold-out round: the half year before the test reviews."""
        between = f"o_orderdate >= '{OLD_TEST_FROM}' AND o_orderdate < '{TEST_FROM}'"
        return self._unlabelled(
            Split(
                review=self._reviews(between),
                business=self._businesses("p_partkey % 20 = 1"),
                user=self._users("c_custkey % 14 = 1", first_count=0),
                checkin=self._checkins("user_id % 20 = 1"),
            )
        )

    @cached_property
    def id_lookup(self) -> DataFrame:
        """A recommendation id per (user, business) pair of the test reviews."""
        number = F.conv(F.substring(F.md5("review_id"), 1, 8), 16, 10).cast("bigint")
        return self.raw_test.review.groupBy("user_id", "business_id").agg(
            F.min(number).alias("RecommendationId")
        )

    @cached_property
    def review_text(self) -> DataFrame:
        return self.table("documents").select(c("doc_id").alias("review_id"), "text")

    @cached_property
    def lexicon(self) -> DataFrame:
        """Plain words of the benchmark passages, scored -5 to 5 by their length."""
        found = self.table("benchmark").selectExpr(
            "explode(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS term"
        )
        return found.distinct().selectExpr("term", "cast(length(term) % 11 - 5 AS int) AS score")

    # ---- cleaned, combined, with features -------------------------------------------------

    @cached_property
    def cleaned(self) -> tuple[Split, Split]:
        return clean_splits(self.raw_train, self.raw_test)

    @property
    def train(self) -> Split:
        return self.cleaned[0]

    @property
    def test(self) -> Split:
        return self.cleaned[1]

    @cached_property
    def everything(self) -> Split:
        return combine(self.train, self.test)

    @cached_property
    def dimensions(self) -> StagedDimensions:
        return StagedDimensions(self.train, self.everything)

    @cached_property
    def sets(self) -> ReviewSets:
        return ReviewSets(self.train, self.test, self.everything, self.dimensions)

    @cached_property
    def subset_sources(self) -> SubsetSources:
        return SubsetSources(
            self.train, self.test, self.everything, self.sets, self.dimensions
        )
