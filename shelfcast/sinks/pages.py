"""A sorted report stored so that any page of it is read without the ones before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..constants import PAGE_SIZE, SKU
from ..schemas import extended

RANGE, PLACE = "page_range", "page_place"
RANGE_ROWS = 250_000  # rows that a task sorts and a range holds, about


def write_pages(
    rows: DataFrame, path: str, keys: Sequence[str] = SKU, *, ranges: int | None = None
) -> None:
    """Stores ``rows`` in key ranges, each in order, and an index of the ranges.

    A row is stored with its place in its range; the index holds where each range starts,
    a running sum over one row a range. Keys need a total order: ties end up on either side.
    Unless told otherwise there is a range for each ``RANGE_ROWS`` rows, so a task sorts no
    more of a larger report. The rows are computed once, for their number, the borders of the
    ranges and the write, and kept on disk meanwhile.
    """
    own = rows.storageLevel == StorageLevel.NONE
    kept = rows.persist(StorageLevel.DISK_ONLY) if own else rows
    ranges = ranges or max(1, -(-kept.count() // RANGE_ROWS))
    ranged = kept.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id())
    # The range comes first, as the writer wants rows in its order and would sort them again.
    placed = ranged.sortWithinPartitions(RANGE, *keys).withColumn(
        # Ids are the partition's number and, in the lower 33 bits, the row's place in it.
        PLACE, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    placed.write.partitionBy(RANGE).parquet(f"{path}/rows")
    if own:
        kept.unpersist()
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/columns")
    counts = _stored(spark, path).groupBy(RANGE).agg(F.count("*").alias("rows"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("bigint")
    counts.withColumn("first_row", starts).coalesce(1).write.parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(extended(columns, f"{PLACE} bigint, {RANGE} int")).parquet(f"{path}/rows")


def read_page(
    spark: SparkSession, path: str, number: int, size: int = PAGE_SIZE, keys: Sequence[str] = SKU
) -> DataFrame:
    """Page ``number``, counted from 0: reads the ranges that hold it, and in these the row
    groups that do; no row before it is sorted or skipped."""
    first, end = number * size, (number + 1) * size
    index = spark.read.parquet(f"{path}/index")
    held = index.filter((F.col("first_row") < end) & (F.col("first_row") + F.col("rows") > first))
    ranges = {row[RANGE]: row["first_row"] for row in held.collect()}
    wanted = F.lit(False)
    for name, start in ranges.items():
        place = F.col(PLACE)
        wanted = wanted | ((F.col(RANGE) == name) & (place >= first - start) & (place < end - start))
    return _stored(spark, path).filter(wanted).orderBy(*keys).drop(RANGE, PLACE)


def stored_page_count(spark: SparkSession, path: str, size: int = PAGE_SIZE) -> DataFrame:
    """(rows, pages), from the index alone."""
    total = F.coalesce(F.sum("rows"), F.lit(0))
    return spark.read.parquet(f"{path}/index").agg(
        total.cast("bigint").alias("rows"), F.ceil(total / size).cast("bigint").alias("pages")
    )
