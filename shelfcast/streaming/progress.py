"""What each micro-batch did, as rows of a table: input, late rows, state, quality counts.

A row is written when Spark reports a batch, also while the query runs on. ``late`` is
Spark's own count of what the watermark dropped. It drops groups, not events: one for each
(window, SKU) of a batch that has closed, so a late event counts once for each of its closed
windows, and together with others of the same window and SKU.
"""

from __future__ import annotations

import json
from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..schemas import PROGRESS
from ..sources.tables import read_log

QUALITY = "quality"  # the name that observed counts go by


class ProgressLog(StreamingQueryListener):
    """Appends a row for each micro-batch of the session's queries to the table under ``path``.

    Register it with ``spark.streams.addListener`` before the queries start, and wait for
    :meth:`finished` before the table of an ended query is read: reports are asynchronous.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._ended: dict[str, Event] = {}

    def _end_of(self, run: str) -> Event:
        return self._ended.setdefault(run, Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        batch = event.progress
        counts = batch.observedMetrics.get(QUALITY)
        row = (
            str(batch.id),
            int(batch.batchId),
            str(batch.timestamp),
            int(batch.numInputRows),
            sum(int(state.numRowsDroppedByWatermark) for state in batch.stateOperators),
            sum(int(state.numRowsTotal) for state in batch.stateOperators),
            batch.eventTime.get("watermark"),
            counts and json.dumps(counts.asDict()),
        )
        rows = self.spark.createDataFrame([row], PROGRESS)
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def finished(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """All batches of an ended query have been written."""
        return self._end_of(str(query.runId)).wait(seconds)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row for each query and batch; of a batch that ran again, the last report."""
    rows = read_log(spark, path, PROGRESS)
    keys = ("query_id", "batch_id")
    last = [F.max_by(c, "reported_at").alias(c) for c in PROGRESS.fieldNames() if c not in keys]
    return rows.groupBy(*keys).agg(*last)


def late_report(progress: DataFrame) -> DataFrame:
    """(query_id, batch_id, rows_in, valid, late) of the batches with input or late rows."""
    valid = F.get_json_object("quality", "$.valid").cast("bigint")
    return progress.filter("rows_in > 0 OR late > 0").select(
        "query_id", "batch_id", "rows_in", F.coalesce(valid, F.lit(0).cast("bigint")).alias("valid"), "late"
    )
