"""Scans: the tables are written out as files first, then read by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stargauge import schemas
from stargauge.frames import Split
from stargauge.plans.dimensions import read_dimensions, write_dimensions
from stargauge.queries.columns import r6, text_list
from stargauge.queries.registry import query
from stargauge.sources import readers
from stargauge.sources.scratch import scratch_path
from stargauge.sources.warehouse import Warehouse
from stargauge.sources.writers import write_csv, write_dimension

c = F.col


def _write_json(w: Warehouse, df: DataFrame, label: str) -> str:
    path = scratch_path(w.spark, label)
    df.write.json(path)
    return path


@query(
    "s1_json_lines",
    """SELECT review_id, CAST(user_id AS VARCHAR) AS user_id,
              CAST(business_id AS VARCHAR) AS business_id, rev_stars AS stars, useful,
              CAST(written AS DATE) AS date, 'review' AS type
       FROM v_train_reviews""",
)
def json_lines(w: Warehouse) -> DataFrame:
    path = _write_json(w, w.raw_train.review, "reviews-json")
    reviews = readers.read_json_lines(w.spark, path, schemas.REVIEW)
    return reviews.select(
        "review_id", "user_id", "business_id", "stars", c("votes.useful"), "date", "type"
    )


@query(
    "s2_csv_rows",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id,
              CAST(RecommendationId AS VARCHAR) AS recommendation FROM v_lookup""",
)
def csv_rows(w: Warehouse) -> DataFrame:
    path = scratch_path(w.spark, "lookup-rows")
    write_csv(w.id_lookup, path, ["user_id", "business_id", "RecommendationId"], header=False)
    return readers.read_csv_rows(w.spark, path).toDF("user_id", "business_id", "recommendation")


@query(
    "s3_csv_table",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id,
              RecommendationId FROM v_lookup""",
)
def csv_table(w: Warehouse) -> DataFrame:
    path = scratch_path(w.spark, "lookup")
    write_csv(w.id_lookup, path, ["user_id", "business_id", "RecommendationId"])
    return readers.read_csv_table(w.spark, path, schemas.ID_LOOKUP)


def _write_split(w: Warehouse, split: Split, prefix: str) -> None:
    # Lines repeat all field names, so packed files are a small part of plain ones.
    for entity in schemas.ENTITIES:
        getattr(split, entity).write.json(f"{prefix}_{entity}.json", compression="gzip")


_SPLIT_COUNTS = """
    SELECT 'train' AS split, 'review' AS entity, count(*) AS n, count(DISTINCT review_id) AS keys
    FROM v_train_reviews
    UNION ALL SELECT 'test', 'review', count(*), count(DISTINCT review_id) FROM v_test_reviews
    UNION ALL SELECT 'old_test', 'review', count(*), count(DISTINCT review_id)
        FROM v_train_reviews WHERE written >= TIMESTAMP '1999-07-01'
    UNION ALL SELECT 'train', 'business', count(*), count(*) FROM v_train_business
    UNION ALL SELECT 'test', 'business', count(*), count(*) FROM v_test_business
    UNION ALL SELECT 'old_test', 'business', count(*), count(*)
        FROM v_all_business WHERE business_id % 20 = 1
    UNION ALL SELECT 'train', 'user', count(*), count(*) FROM v_train_user
    UNION ALL SELECT 'test', 'user', count(*), count(*) FROM v_test_user
    UNION ALL SELECT 'old_test', 'user', count(*), count(*)
        FROM v_all_user WHERE user_id % 14 = 1
    UNION ALL SELECT 'train', 'checkin', count(*), count(*)
        FROM v_checkin WHERE business_id % 10 <> 0
    UNION ALL SELECT 'test', 'checkin', count(*), count(*)
        FROM v_checkin WHERE business_id % 10 = 0
    UNION ALL SELECT 'old_test', 'checkin', count(*), count(*)
        FROM v_checkin WHERE business_id % 20 = 1
    UNION ALL SELECT 'test', 'lookup', count(*), count(*) FROM v_lookup"""


@query("s4_load_splits", _SPLIT_COUNTS)
def load_splits(w: Warehouse) -> DataFrame:
    folder = scratch_path(w.spark, "splits")
    raw = {"train": w.raw_train, "test": w.raw_test, "old_test": w.raw_old_test}
    for name, split in raw.items():
        _write_split(w, split, f"{folder}/{readers.SPLIT_PREFIXES[name]}")
    write_csv(
        w.id_lookup,
        f"{folder}/{readers.FILES['lookup']}",
        ["user_id", "business_id", "RecommendationId"],
    )
    splits, lookup = readers.read_splits(w.spark, folder)
    keys = {
        "review": "review_id",
        "business": "business_id",
        "user": "user_id",
        "checkin": "business_id",
    }

    def counted(df: DataFrame, split: str, entity: str, key) -> DataFrame:
        return df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).select(
            F.lit(split).alias("split"), F.lit(entity).alias("entity"), "n", "keys"
        )

    result = counted(lookup, "test", "lookup", F.struct("user_id", "business_id"))
    for name, split in splits.items():
        for entity, key in keys.items():
            result = result.unionAll(counted(getattr(split, entity), name, entity, c(key)))
    return result


@query(
    "s5_category_averages",
    """SELECT 'reviews' AS dimension, category AS key, CAST(cat_count AS DOUBLE) AS n,
              round(cat_avg_stars, 6) AS avg_stars FROM v_review_categories
       UNION ALL SELECT 'businesses', category, cat_tot_count, round(cat_avg_stars, 6)
       FROM v_business_categories
       UNION ALL SELECT 'grouped', array_to_string(bus_categories, '|'),
                        CAST(cat_counts AS DOUBLE), round(cat_avg_stars, 6)
       FROM v_grouped_categories""",
)
def category_averages(w: Warehouse) -> DataFrame:
    folder = scratch_path(w.spark, "dimensions")
    write_dimensions(w.dimensions, w.everything, folder)
    read = read_dimensions(w.spark, folder)

    def shaped(df: DataFrame, label: str, key, n: str) -> DataFrame:
        return df.select(
            F.lit(label).alias("dimension"),
            key.alias("key"),
            c(n).cast("double").alias("n"),
            r6("cat_avg_stars", "avg_stars"),
        )

    return (
        shaped(read.review_categories, "reviews", c("category"), "cat_count")
        .unionAll(shaped(read.business_categories, "businesses", c("category"), "cat_tot_count"))
        .unionAll(
            shaped(read.grouped_categories, "grouped", text_list("bus_categories"), "cat_counts")
        )
    )


@query(
    "s6_grouped_businesses",
    """SELECT CAST(business_id AS VARCHAR) AS business_id, grp_cat_counts,
              round(grp_cat_avg_stars, 6) AS grp_cat_avg_stars FROM v_grouped_businesses""",
)
def grouped_businesses(w: Warehouse) -> DataFrame:
    folder = scratch_path(w.spark, "dimensions")
    write_dimensions(w.dimensions, w.everything, folder)
    read = readers.read_grouped_businesses(w.spark, folder)
    return read.select("business_id", "grp_cat_counts", r6("grp_cat_avg_stars"))


@query(
    "s7_name_averages",
    """SELECT bus_name, bus_name_counts, total_stars, round(bus_name_avg, 6) AS bus_name_avg
       FROM v_names""",
)
def name_averages(w: Warehouse) -> DataFrame:
    folder = scratch_path(w.spark, "names")
    write_dimension(w.dimensions.names, f"{folder}/{readers.FILES['names']}")
    read = readers.read_name_averages(w.spark, folder)
    return read.select("bus_name", "bus_name_counts", "total_stars", r6("bus_name_avg"))


@query("s8_lexicon", "SELECT term, score FROM v_lexicon")
def lexicon(w: Warehouse) -> DataFrame:
    path = scratch_path(w.spark, "lexicon")
    plain = w.lexicon.select("term", "score").write.option("sep", "\t").option("quote", "")
    plain.csv(path)
    return readers.read_lexicon(w.spark, path)


_KEYED_SQL = """
    SELECT review_id, max_by(stars, sequence) AS stars, max(sequence) AS sequence
    FROM (SELECT concat_ws('-', l_orderkey, l_linenumber) AS review_id,
                 CAST((CAST(l_quantity AS INT) - 1) % 5 + 1 AS BIGINT) AS stars,
                 (l_partkey * 10000 + l_suppkey) * 100000000
                     + CAST(round(l_extendedprice * 100) AS BIGINT) AS sequence FROM lineitem)
    GROUP BY review_id"""


def keyed_reviews(w: Warehouse) -> DataFrame:
    """Line items under a key that repeats, with a number that orders the repeats."""
    return w.table("lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS review_id",
        "cast((cast(l_quantity AS int) - 1) % 5 + 1 AS bigint) AS stars",
        "(l_partkey * 10000 + l_suppkey) * 100000000"
        " + cast(round(l_extendedprice * 100) AS bigint) AS sequence",
    )


@query("s9_keyed_reviews", _KEYED_SQL)
def last_rows_of_file(w: Warehouse) -> DataFrame:
    path = _write_json(w, keyed_reviews(w), "keyed-json")
    read = readers.read_keyed_reviews(w.spark, path, sequence="sequence")
    return read.select("review_id", "stars", "sequence")
