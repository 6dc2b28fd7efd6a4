"""Daily totals of SKUs kept beside the windowed table: only changed dates are summed again."""

from __future__ import annotations

from collections import defaultdict
from datetime import date, datetime, timezone
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import WindowSpec
from ..operators.trends import daily_skus
from ..schemas import DAILY, ROLLED, WINDOWED, extended
from ..sources.tables import read_log

_DATE = "window_date="


def _files_of_dates(stored: DataFrame) -> dict[date, str]:
    """What names the files of each date: files are never changed, only added or replaced."""
    names = defaultdict(list)
    for path in stored.inputFiles():
        if _DATE in path:
            day = path.partition(_DATE)[2].split("/")[0]
            names[date.fromisoformat(day)].append(path.rpartition("/")[2])
    return {day: sha256("\n".join(sorted(files)).encode()).hexdigest() for day, files in names.items()}


def refresh_daily(spark: SparkSession, windows: str, rollup: str, spec: WindowSpec) -> list[date]:
    """Sums the dates of the windowed table (date layout) whose files differ from those of
    the last refresh, and returns them; the other dates are not read.

    The names are committed after the sums, so a refresh that fails is done again.
    """
    stored = spark.read.schema(extended(WINDOWED, "window_date date")).parquet(windows)
    found = _files_of_dates(stored)
    done = read_log(spark, f"{rollup}/commits", ROLLED)
    last = done.groupBy("day").agg(F.max_by("files", "rolled_at").alias("files"))
    known = {row.day: row.files for row in last.collect()}  # a row a date
    changed = sorted(day for day, files in found.items() if known.get(day) != files)
    if not changed:
        return []
    rows = daily_skus(stored.filter(F.col("window_date").isin(changed)).drop("window_date"), spec)
    rows.select(*DAILY.fieldNames()).hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("day").parquet(f"{rollup}/days")
    now = datetime.now(timezone.utc)
    rolled = spark.createDataFrame([(day, found[day], now) for day in changed], ROLLED)
    rolled.coalesce(1).write.mode("append").parquet(f"{rollup}/commits")
    return changed


def read_daily(spark: SparkSession, rollup: str) -> DataFrame:
    """The totals of each SKU and day, as ``daily_skus`` gives them."""
    return spark.read.schema(DAILY).parquet(f"{rollup}/days").select(*DAILY.fieldNames())
