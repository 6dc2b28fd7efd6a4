"""Stored results: windows, stock snapshots, reorders, models, runs."""

from __future__ import annotations

from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import SKU
from ..operators.filters import by_action
from ..schemas import INVENTORY, RUNS, WINDOWED, extended
from ..sources.tables import compacted_dates, read_windowed

# Layouts of the windowed table. One directory per SKU suits a few hundred SKUs
# and lookups by path; by date the number of directories does not grow with the
# catalogue and files are sorted so that row-group statistics prune the ids.
BY_SKU = SKU
BY_DATE = ("window_date",)


def _with_date(windows: DataFrame) -> DataFrame:
    return windows.withColumn("window_date", F.to_date("window_start"))


def write_windowed(
    windows: DataFrame, path: str, layout: tuple[str, ...] = BY_DATE, *,
    partitions: int | None = None, mode: str = "append",
) -> None:
    """Batch write of the windowed table.

    Rows are range-partitioned by directory, SKU and time. Ranges follow the
    data, so a hot store or SKU is spread over as many files as it fills, and
    each file covers a narrow key range.
    """
    order = [*dict.fromkeys((*layout, *SKU, "window_start"))]
    rows = _with_date(windows)
    ranged = (
        rows.repartitionByRange(*order)
        if partitions is None
        else rows.repartitionByRange(partitions, *order)
    )
    if "window_date" not in layout:
        ranged = ranged.drop("window_date")
    ranged.sortWithinPartitions(*order).write.mode(mode).partitionBy(*layout).parquet(path)


def compact_windowed(
    spark: SparkSession, source: str, target: str, layout: tuple[str, ...] = BY_DATE, *,
    partitions: int | None = None,
) -> None:
    """Rewrite a table of many small streaming files into a new path."""
    write_windowed(read_windowed(spark, source), target, layout, partitions=partitions, mode="error")


def compact_closed(
    spark: SparkSession, source: str, target: str, before: date, *, partitions: int | None = None
) -> list[date]:
    """Rewrite the dates before ``before`` that are not compacted yet; returns them.

    Only dates without windows still to come should be compacted. A date is moved once
    and committed after its files are complete; ``read_compacted`` reads both tables.
    """
    done = compacted_dates(spark, target)
    rows = read_windowed(spark, source, extended(WINDOWED, "window_date date"))
    rows = rows.filter(F.col("window_date") < F.lit(before))
    rows = rows.filter(~F.col("window_date").isin(done)) if done else rows
    days = sorted(row[0] for row in rows.select("window_date").distinct().collect())
    if not days:
        return []
    # Files of an attempt that was not committed are replaced date by date.
    order = ["window_date", *SKU, "window_start"]
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("window_date").parquet(f"{target}/data")
    committed = spark.createDataFrame([(day,) for day in days], "window_date date")
    committed.coalesce(1).write.mode("append").parquet(f"{target}/commits")
    return days


def write_inventory_csv(inventory: DataFrame, path: str) -> None:
    """A snapshot as CSV with a header, in a path of its own."""
    inventory.select(*INVENTORY.fieldNames()).write.option("header", True).csv(path)


def export_reorders(decisions: DataFrame, path: str) -> None:
    """The REORDER rows as CSV with a header."""
    by_action(decisions, "REORDER").write.option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def append_run(run: DataFrame, path: str) -> None:
    run.select(*RUNS.fieldNames()).write.mode("append").parquet(path)
