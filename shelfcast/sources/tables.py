"""Stored relations: windowed aggregates, inventory, sellers, runs, models."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..constants import IDLE, MODEL_CURRENT, SKU
from ..schemas import INVENTORY, RUNS, SELLERS, WINDOWED, extended, schema

def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_windowed(
    spark: SparkSession, path: str, columns: StructType | None = WINDOWED,
    *, merge_schema: bool = False,
) -> DataFrame:
    """The whole windowed table from its root.

    Reading the root honours the streaming sink's commit log. The fixed schema
    spares the footer pass over all files and keeps ids text when they are
    partition directories; ``columns=None`` discovers it, with ``merge_schema``
    over files of different age.
    """
    if columns is not None:
        return spark.read.schema(columns).parquet(path).select(*columns.fieldNames())
    rows = spark.read.option("mergeSchema", merge_schema).parquet(path)
    return rows.withColumns({k: F.col(k).cast("string") for k in SKU})


def stream_windowed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New rows of the windowed table as a stream."""
    reader = spark.readStream.schema(extended(WINDOWED, "window_date date")).options(**options)
    return reader.parquet(path).select(*WINDOWED.fieldNames())


def read_compacted(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A windowed table and the closed dates that ``compact_closed`` moved to ``target``."""
    done = compacted_dates(spark, target)
    live = read_windowed(spark, source, extended(WINDOWED, "window_date date"))
    live = live.filter(~F.col("window_date").isin(done)) if done else live
    rows = live.drop("window_date")
    if not done:
        return rows
    closed = [f"{target}/data/window_date={day}" for day in done]
    return rows.unionByName(spark.read.schema(WINDOWED).parquet(*closed))


def compacted_dates(spark: SparkSession, target: str) -> list[date]:
    """The dates that have been compacted; a row a date."""
    try:
        days = spark.read.schema(schema("window_date date")).parquet(f"{target}/commits")
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return []
    return sorted(row[0] for row in days.distinct().collect())


def query_windowed(
    spark: SparkSession, path: str, store: str | None = None, product: str | None = None,
    since: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    """Rows of one store, one SKU or one time span (``until`` is exclusive).

    With the date layout the span also prunes directories; the ids are pruned
    by directory or by row-group statistics, whichever the layout offers.
    """
    rows = read_windowed(spark, path, extended(WINDOWED, "window_date date"))
    for name, value in zip(SKU, (store, product)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    # Tables without the date layout hold no window_date: it reads as null.
    day = F.col("window_date")
    # Spark cuts the dates itself, from the same literals and in the same zone as the writer.
    if since is not None:
        first = F.lit(since)
        rows = rows.filter((F.col("window_start") >= first) & (day.isNull() | (day >= F.to_date(first))))
    if until is not None:
        end = F.lit(until)
        rows = rows.filter((F.col("window_start") < end) & (day.isNull() | (day <= F.to_date(end))))
    return rows.drop("window_date")


def register_windowed(spark: SparkSession, path: str, view: str) -> None:
    """Expose the table to ``spark.sql`` under a temporary name."""
    read_windowed(spark, path).createOrReplaceTempView(view)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """CSV snapshot with a header; text in a number column fails the job."""
    return (
        spark.read.schema(INVENTORY)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_sellers(spark: SparkSession, path: str) -> DataFrame:
    """CSV seller master, one row per SKU; no file means no sellers.

    The last line of a repeated SKU wins. Row order inside a file is given by
    its block and the row's place in the block.
    """
    try:
        rows = (
            spark.read.schema(SELLERS)
            .option("header", True)
            .option("enforceSchema", False)
            .csv(path)
        )
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return spark.createDataFrame([], SELLERS)
    place = F.struct(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()
    )
    data = [f.name for f in SELLERS if f.name not in SKU]
    return (
        rows.select(*SELLERS.fieldNames(), place.alias("place"))
        .groupBy(*SKU)
        .agg(F.max_by(F.struct(*data), "place").alias("row"))
        .select(*SKU, "row.*")
    )


def read_log(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """A whole log; empty when nothing has been written yet."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return spark.createDataFrame([], columns)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, RUNS)


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the last record, or the idle default when the log is empty."""
    last = runs.agg(F.max_by(F.struct(*RUNS.fieldNames()), "recorded_at").alias("run"))
    return last.select("run.*").withColumns(
        {
            "status": F.coalesce("status", F.lit(IDLE)),
            "model_version": F.coalesce("model_version", F.lit(MODEL_CURRENT)),
        }
    )


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Fail when there is nothing to work on."""
    if df.isEmpty():
        raise ValueError("no rows")
    return df
