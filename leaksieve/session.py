"""Session settings that the scan asks for."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Texts reach Python in Arrow batches of about so many bytes; Spark's default of 64 MB is held several times over by each worker."""
    spark.conf.set(BATCH, size)
