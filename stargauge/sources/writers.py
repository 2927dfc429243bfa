"""Sinks. Spark writes a folder per result; the run time is part of the folder's name."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stargauge.functions.numeric import clamp

# Column names of a submission file.
PREDICTED = "stars"
REVIEW_KEY = "review_id"
LOOKUP_KEY = "RecommendationId"


def _stamp() -> str:
    """Sorts by time; the random end keeps runs of one second apart."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def write_csv(
    df: DataFrame, path: str, columns: list[str] | None = None, header: bool = True
) -> str:
    """Dump a frame, or the chosen columns of it."""
    chosen = df.select(*columns) if columns else df
    writer = chosen.write.option("header", header).option("escape", '"')
    writer.csv(path, mode="error")
    return path


def write_dimension(df: DataFrame, path: str) -> str:
    """A dimension with its key: CSV, or Parquet where the key is a list."""
    if any(kind.startswith("array") for _, kind in df.dtypes):
        df.write.parquet(path, mode="error")
        return path
    return write_csv(df, path)


def write_sentiment(scores: DataFrame, path: str) -> str:
    """Headerless ``score, review_id`` lines."""
    return write_csv(scores, path, ["score", REVIEW_KEY], header=False)


def _submission_path(folder: str, submission: str, *labels: str) -> str:
    name = "--".join([f"Submission{submission}", _stamp(), *labels])
    return f"{folder.rstrip('/')}/{name}.csv"


def write_predictions(
    df: DataFrame,
    folder: str,
    model: str,
    subset: str,
    submission: str,
    prediction: str | None = None,
    low: float | None = None,
    high: float | None = None,
) -> str:
    """``review_id, stars`` lines from ``predictions_<model>``; unbounded unless asked."""
    value = F.col(prediction or f"predictions_{model}")
    path = _submission_path(folder, submission, model, subset)
    return write_csv(df.select(REVIEW_KEY, clamp(value, low, high).alias(PREDICTED)), path)


def write_benchmark(df: DataFrame, folder: str, benchmark: str, submission: str) -> str:
    """``RecommendationId, stars`` lines from ``benchmark_<name>``."""
    path = _submission_path(folder, submission, benchmark)
    return write_csv(
        df.select(LOOKUP_KEY, F.col(f"benchmark_{benchmark}").alias(PREDICTED)), path
    )


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{_stamp()}--{name}"
    model.write().save(path)
    return path


def saved_models(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Paths of the saved models of a name, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    paths = [status.getPath().toString() for status in found]
    return sorted(path for path in paths if path.endswith(f"--{name}"))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
