"""A test device: a folder for intermediate tables where a session on one machine names none. The library itself never chooses one."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_shared_folder(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; only where it is unset, use a folder of this machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plantpulse-"))
