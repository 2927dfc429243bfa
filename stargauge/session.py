"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stargauge.sources.scratch import shared_dir

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One business or user may own a large share of all reviews.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app: str = "stargauge", master: str | None = None, **settings: str
) -> SparkSession:
    """Get a session; ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # Fails here, not in the middle of a run, if the cluster names no shared folder.
    shared_dir(spark)
    return spark
