"""File streams: whole micro-batches go through the batch operators.

A review, and a business with its check-ins, is one line of one file, so a micro-batch has all that
its rows need and nothing is kept between batches. What has been read is in the checkpoint folder;
a batch that is repeated after a failure replaces its own output, so every row is written once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stargauge import schemas
from stargauge.operators.features import with_total_checkins
from stargauge.operators.sentiment import sentiment_scores

BATCH = "batch"


def stream_json_lines(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1000
) -> DataFrame:
    """Files of one JSON object per line, as they appear below ``path``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def run_batches(
    stream: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    follow: bool = False,
) -> StreamingQuery:
    """Start writing ``work`` of every micro-batch as Parquet, one folder per batch.

    Ends when all files that are there have been read, unless it is to ``follow``.
    """

    def write(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{output.rstrip('/')}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer if follow else writer.trigger(availableNow=True)).start()


def read_batches(spark: SparkSession, output: str) -> DataFrame:
    """The rows of all batches so far."""
    return spark.read.parquet(output).drop(BATCH)


def score_stream(
    reviews: DataFrame, lexicon: DataFrame, output: str, checkpoint: str, follow: bool = False
) -> StreamingQuery:
    """``review_id, score`` of a stream of reviews: each batch meets the lexicon, a static table."""

    def work(rows: DataFrame) -> DataFrame:
        return sentiment_scores(rows.select("review_id", "text"), lexicon)

    return run_batches(reviews, work, output, checkpoint, follow)


def checkin_stream(
    checkins: DataFrame, output: str, checkpoint: str, follow: bool = False
) -> StreamingQuery:
    """``business_id, calc_total_checkins`` of a stream of cleaned check-ins."""

    def work(rows: DataFrame) -> DataFrame:
        return with_total_checkins(rows).select("business_id", "calc_total_checkins")

    return run_batches(checkins, work, output, checkpoint, follow)


def score_review_files(
    spark: SparkSession, folder: str, lexicon: DataFrame, output: str, checkpoint: str
) -> DataFrame:
    """Score the review files of a folder that have not been scored yet; all scores so far."""
    reviews = stream_json_lines(spark, folder, schemas.REVIEW)
    score_stream(reviews, lexicon, output, checkpoint).awaitTermination()
    return read_batches(spark, output)
