"""Session settings for large runs, and the shared folder for stored stages."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession

# Wide scans aggregate to bounded key domains, so larger splits mean better
# map-side combining and fewer partial rows to shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.session.timeZone": "UTC",
    # No call-site capture for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(app_name: str = "fringeflow", **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = _local_dir()
    return folder.rstrip("/")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="fringeflow-")
