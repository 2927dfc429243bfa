"""The per-row operators on streams of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stargauge.queries.aggregates import A8_SQL, A10_SQL
from stargauge.queries.registry import query
from stargauge.sources.scratch import scratch_path
from stargauge.sources.staging import stage
from stargauge.sources.warehouse import Warehouse
from stargauge.streaming import files


def _streamed(w: Warehouse, df: DataFrame, label: str) -> DataFrame:
    """A table as a stream of its files."""
    path = scratch_path(w.spark, label)
    df.write.parquet(path)
    return w.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("a10_streamed_sentiment", A10_SQL)
def streamed_sentiment(w: Warehouse) -> DataFrame:
    output = scratch_path(w.spark, "streamed-scores")
    files.score_stream(
        _streamed(w, w.review_text, "arriving-reviews"),
        stage(w.lexicon, "lexicon"),
        output,
        scratch_path(w.spark, "score-progress"),
    ).awaitTermination()
    return files.read_batches(w.spark, output)


@query("a8_streamed_checkins", A8_SQL)
def streamed_checkins(w: Warehouse) -> DataFrame:
    output = scratch_path(w.spark, "streamed-checkins")
    everything = w.everything
    joined = everything.business.select("business_id").join(everything.checkin, "business_id", "left")
    files.checkin_stream(
        _streamed(w, joined, "arriving-checkins"), output, scratch_path(w.spark, "checkin-progress")
    ).awaitTermination()
    return files.read_batches(w.spark, output)
