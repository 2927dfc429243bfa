"""Scans of JSON-lines, CSV and tab-separated files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stargauge import schemas
from stargauge.frames import Split
from stargauge.operators.cleaning import last_per_key

# Default file names; every reader that uses them takes others.
SPLIT_PREFIXES = {"train": "train", "test": "test", "old_test": "old_test"}
FILES = {
    "lookup": "id_lookup.csv",
    "review_categories": "review_categories.csv",
    "business_categories": "business_categories.csv",
    "grouped_categories": "grouped_categories.parquet",
    "grouped_businesses": "grouped_businesses.csv",
    "names": "name_averages.csv",
}


def file_order() -> Column:
    """Orders the rows of a scan by file, then block, then line."""
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line. Fields absent from a line become NULL."""
    return spark.read.schema(schema).json(path)


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Headerless scan: every field a string, a header line stays a row."""
    return spark.read.option("header", False).option("escape", '"').csv(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header line; quotes inside a field are doubled."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"')
    return reader.csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``term``/``score`` lines; a term given twice keeps its last score."""
    reader = spark.read.schema(schemas.LEXICON).option("sep", "\t").option("quote", "")
    scored = reader.csv(path).withColumn("line", file_order())
    return last_per_key(scored, "term", "line").drop("line")


def read_split(spark: SparkSession, folder: str, prefix: str) -> Split:
    """The files ``<prefix>_<entity>.json`` of one split."""
    base = f"{folder.rstrip('/')}/{prefix}"
    return Split(
        **{
            entity: read_json_lines(spark, f"{base}_{entity}.json", schema)
            for entity, schema in schemas.ENTITIES.items()
        }
    )


def read_splits(
    spark: SparkSession,
    folder: str,
    prefixes: Mapping[str, str] = SPLIT_PREFIXES,
    lookup: str = FILES["lookup"],
) -> tuple[dict[str, Split], DataFrame]:
    """The four entities of every split, and the id lookup."""
    splits = {split: read_split(spark, folder, prefix) for split, prefix in prefixes.items()}
    return splits, read_csv_table(spark, f"{folder.rstrip('/')}/{lookup}", schemas.ID_LOOKUP)


def read_category_averages(
    spark: SparkSession, folder: str, files: Mapping[str, str] = FILES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Category averages from reviews, from businesses, and per whole category list."""
    base = folder.rstrip("/")
    grouped = spark.read.schema(schemas.GROUPED_CATEGORY_AVERAGES)
    return (
        read_csv_table(
            spark, f"{base}/{files['review_categories']}", schemas.REVIEW_CATEGORY_AVERAGES
        ),
        read_csv_table(
            spark, f"{base}/{files['business_categories']}", schemas.BUSINESS_CATEGORY_AVERAGES
        ),
        grouped.parquet(f"{base}/{files['grouped_categories']}"),
    )


def read_grouped_businesses(
    spark: SparkSession, folder: str, name: str = FILES["grouped_businesses"]
) -> DataFrame:
    return read_csv_table(spark, f"{folder.rstrip('/')}/{name}", schemas.GROUPED_BUSINESSES)


def read_name_averages(
    spark: SparkSession, folder: str, name: str = FILES["names"]
) -> DataFrame:
    return read_csv_table(spark, f"{folder.rstrip('/')}/{name}", schemas.NAME_AVERAGES)


def read_keyed_reviews(spark: SparkSession, path: str, sequence: str | None = None) -> DataFrame:
    """Reviews with one row per ``review_id``: the last one in file order.

    ``sequence`` names a column that orders the rows. Without it, the order of the files and
    of the lines inside each file counts.
    """
    schema = schemas.REVIEW
    if sequence and sequence not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(sequence, T.LongType())])
    reviews = read_json_lines(spark, path, schema)
    if sequence:
        return last_per_key(reviews, "review_id", sequence)
    return last_per_key(
        reviews.withColumn("line", file_order()), "review_id", "line"
    ).drop("line")
