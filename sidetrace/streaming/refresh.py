"""Refresh as a stream of snapshot folders: each new folder is compared with the last published one and gated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def replay(spark: SparkSession, folder: str, schema: str | T.StructType, apply: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1) -> None:
    """Runs ``apply`` once for each Parquet snapshot file that hasn't been seen, in order of arrival, and stops.

    The offsets are kept in the checkpoint folder, so a restarted refresh repeats at most the batch that failed; apply gets
    the batch number and should be idempotent by it, as publishing by version is.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
