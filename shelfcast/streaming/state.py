"""What a checkpoint remembers, read as tables through Spark's state data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import SKU


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row for each stateful operator: its number, name, partitions and batches kept."""
    found = spark.read.format("state-metadata").load(checkpoint)
    return found.select("operatorId", "operatorName", "numPartitions", "minBatchId", "maxBatchId")


def state_rows(
    spark: SparkSession, checkpoint: str, operator: int = 0, batch_id: int | None = None
) -> DataFrame:
    """The key and value of each state row, as of the last committed batch or of an earlier
    one that is still kept."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def open_windows(
    spark: SparkSession, checkpoint: str, batch_id: int | None = None
) -> DataFrame:
    """(window_start, window_end, SKU) of the windows that a windowed job has not closed."""
    key = state_rows(spark, checkpoint, 0, batch_id).select("key.*")
    window = key.columns[0]
    return key.select(
        F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end"), *SKU
    )
