"""Written intermediate tables.

A staged table is read back as a plain scan. Its size is then known to the planner, it
survives the loss of executors, and a join with it starts from two plain shuffles, which is
what the runtime needs to split a skewed key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from stargauge.concurrent import side_by_side
from stargauge.sources.scratch import scratch_path


def stage(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, mode="error")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage independent tables at the same time."""
    if not frames:
        return {}
    spark = next(iter(frames.values())).sparkSession
    labels = list(frames)
    staged = side_by_side(spark, lambda label: stage(frames[label], label), labels)
    return dict(zip(labels, staged, strict=True))
