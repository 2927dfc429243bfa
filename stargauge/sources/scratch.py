"""Shared working folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# One temporary folder per local application.
_local: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process, so that a temporary folder is seen by all."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. Only where tasks run in the driver's own process may
    it be left out; then it is a temporary one."""
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise ValueError(
            f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share"
        )
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="stargauge-")
    return _local[application]


def run_dir(spark: SparkSession) -> str:
    """The folder of all staged tables of this application."""
    return f"{shared_dir(spark)}/stargauge/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the run's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def close_run(spark: SparkSession) -> None:
    """Remove the staged tables of this application; frames that read them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
