"""Structured Streaming wiring.

Each job returns its ``StreamingQuery``; waiting for it and the session's
state-store provider are the caller's choice. State is partitioned by
``spark.sql.shuffle.partitions`` of the first start and keeps that number for
the life of the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..config import DEFAULT_WINDOW, StockPolicy, WindowSpec
from ..constants import SKU, WINDOW
from ..operators.demand import join_demand, sku_features
from ..operators.events import dead_letters, valid_sales
from ..operators.windows import window_sales
from ..plans.decisions import decisions_of
from ..schemas import DECISIONS, SKU_FEATURES, WINDOWED
from ..sinks.tables import BY_DATE
from ..sources.events import parse_events, parse_lines
from ..sources.stock import inventory_changes, inventory_version, read_inventory_snapshot
from .live import BATCH, FOLD_EVERY, claimed, key_range, live_writer, read_live

WINDOW_TRIGGER = "5 seconds"
ROW_TRIGGER = "2 seconds"


def _triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """``every=None`` works off what is there and stops."""
    if every is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)


def _start(
    rows: DataFrame, path: str, checkpoint: str, every: str | None, layout: tuple[str, ...] = ()
) -> StreamingQuery:
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if layout:
        writer = writer.partitionBy(*layout)
    return _triggered(writer, every).start()


def start_validated(
    lines: DataFrame, path: str, checkpoint: str, every: str | None = ROW_TRIGGER
) -> StreamingQuery:
    """Lines to parsed, valid rows; no state."""
    return _start(valid_sales(parse_events(lines)), path, checkpoint, every)


def start_dead_letters(
    lines: DataFrame, path: str, checkpoint: str, every: str | None = ROW_TRIGGER
) -> StreamingQuery:
    """Lines that no window will count, as they came, with the reason and their origin."""
    return _start(dead_letters(parse_lines(lines)), path, checkpoint, every)


def start_console(rows: DataFrame, mode: str = "append", every: str | None = ROW_TRIGGER) -> StreamingQuery:
    """Print each micro-batch, for a look at a running stream."""
    writer = rows.writeStream.outputMode(mode).format("console").option("truncate", False)
    return _triggered(writer, every).start()


def start_windowed(
    sales: DataFrame, path: str, checkpoint: str, spec: WindowSpec = DEFAULT_WINDOW, *,
    mode: str = "append", every: str | None = WINDOW_TRIGGER, layout: tuple[str, ...] = BY_DATE,
    files_per_date: int | None = None, fold_every: int = FOLD_EVERY, panes: bool = False,
) -> StreamingQuery:
    """Valid sales to windowed aggregates.

    ``append`` writes a window once, after the watermark has passed its end; the file
    sink's log makes that exactly-once. With the date layout a trigger writes at most
    ``files_per_date`` files for each date it touches, not one from each state partition:
    a quarter as many as there are state partitions by default, each from a task of its own
    where there are enough. ``panes`` is that of ``window_sales``, for append mode.
    ``update`` keeps the current state of every window, see ``live``;
    :func:`read_live_windows` shows it.
    """
    if panes and mode != "append":
        raise ValueError("chained panes need the append mode")
    windows = window_sales(sales, spec, panes=panes)
    if mode == "append":
        if "window_date" in layout:
            windows = windows.withColumn("window_date", F.to_date("window_start"))
            states = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            share = F.pmod(F.xxhash64(*SKU), F.lit(files_per_date or max(1, states // 4)))
            windows = windows.repartition("window_date", share)
        return _start(windows, path, checkpoint, every, layout)
    if mode == "update":
        part = F.date_format("window_start", "yyyy-MM-dd")
        step = live_writer(path, WINDOWED, (*WINDOW, *SKU), part, fold_every)
        return _per_batch(windows, checkpoint, every, step, path)
    raise ValueError(f"unknown output mode {mode!r}")


def _per_batch(
    rows: DataFrame, checkpoint: str, every: str | None,
    step: Callable[[DataFrame, int], None], path: str,
) -> StreamingQuery:
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    start = _triggered(writer.foreachBatch(step), every).start
    return claimed(rows.sparkSession, path, checkpoint, start)


def read_live_windows(spark: SparkSession, path: str) -> DataFrame:
    """Every window as its last update left it."""
    return read_live(spark, path, WINDOWED, (*WINDOW, *SKU))


def start_decisions(
    windows: DataFrame, inventory: DataFrame | str, path: str, checkpoint: str,
    model: Transformer | None = None, spec: WindowSpec = DEFAULT_WINDOW, *,
    policy: StockPolicy = StockPolicy(), every: str | None = WINDOW_TRIGGER,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Stored windows, read as a stream, to decisions of the SKUs that changed.

    The state store holds the metric maxima of each SKU, so a micro-batch costs
    what changed and not the history; it grows with the catalogue. ``inventory`` is a
    fixed table or the root of versioned stock (``write_inventory``): then every batch
    decides on the last committed version. Where that is another one than the batch before
    decided on, the SKUs in the change feed between the two are decided again: new stock or
    lead times, SKUs that had sold before they were listed, and delisted ones, whose
    decisions go. The metrics of every SKU, listed or not, are remembered for that.

    Everything a batch reads besides its input is as the batch before left it, so a replay
    after a failure at any point gives the same table. A new version takes effect with the
    next batch; a stream without new windows runs none. :func:`read_decisions` shows the
    last decision of each SKU. ``windows`` comes from ``stream_windowed``: a stream cannot
    aggregate its own aggregates in update mode.
    """
    part = key_range(*SKU)
    decide = live_writer(path, DECISIONS, SKU, part, fold_every)
    remember = live_writer(f"{path}/features", SKU_FEATURES, SKU, part, fold_every)

    def step(features: DataFrame, batch_id: int) -> None:
        if isinstance(inventory, DataFrame):
            decide(decisions_of(join_demand(inventory, features), model, spec, policy), batch_id)
            return
        spark = features.sparkSession
        features = features.persist()
        version = inventory_version(spark, inventory)
        before = _decided_on(spark, path, batch_id)
        todo = features.select(*SKU_FEATURES.fieldNames())
        if before is not None and before != version:
            changes = inventory_changes(spark, inventory, before, version).select(*SKU)
            known = read_live(spark, f"{path}/features", SKU_FEATURES, SKU, batch_id)
            again = known.join(changes, [*SKU], "left_semi")
            todo = todo.unionByName(again.join(features.select(*SKU), [*SKU], "left_anti"))
        remember(features, batch_id)
        stock = read_inventory_snapshot(spark, inventory, version).withColumn("listed", F.lit(True))
        stocked = todo.join(stock, [*SKU], "left")
        decided = decisions_of(stocked.filter("listed"), model, spec, policy)
        decide(decided.unionByName(_no_decisions(stocked.filter("listed IS NULL"))), batch_id)
        decided_on = spark.createDataFrame([(version,)], "version string")
        decided_on.write.mode("overwrite").parquet(f"{path}/versions/{BATCH}={batch_id}")
        features.unpersist()

    return _per_batch(sku_features(windows), checkpoint, every, step, path)


def _decided_on(spark: SparkSession, path: str, batch_id: int) -> str | None:
    """The stock version of the last batch before this one; a row a batch."""
    try:
        versions = spark.read.schema(f"version string, {BATCH} bigint").parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.filter(F.col(BATCH) < batch_id).agg(F.max_by("version", BATCH)).first()[0]


def _no_decisions(rows: DataFrame) -> DataFrame:
    """Rows that take the place of decisions on SKUs that aren't listed."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in DECISIONS if f.name not in SKU]
    return rows.select(*SKU, *empty)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The last decision of every listed SKU the decision job has seen."""
    return read_live(spark, path, DECISIONS, SKU).filter(F.col("action").isNotNull())
