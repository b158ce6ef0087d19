"""Stage tables of the library, and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skeinflow.sources.shared import committed, exists, remove, stage, stage_path

__all__ = ["BATCH_BYTES", "bound_batches", "committed", "exists", "remove", "stage", "stage_path"]

#: Bytes in an Arrow batch sent to Python; one longer row still travels whole.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Lets batches follow bytes instead of rows, so long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
