"""Session settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, app: str = "proseledger") -> SparkSession:
    """A session with UTC time, adaptive execution and small Arrow batches, so that long texts fit a task's memory."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
