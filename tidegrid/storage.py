"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import FailedPrecondition


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset a local session gets a folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise FailedPrecondition("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")
