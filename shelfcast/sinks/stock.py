"""Commits of stock versions: whole snapshots, changes of some SKUs, folded parts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import NEW_SKU_LEAD_TIME, SKU
from ..operators.stock import last_corrections, one_per_sku
from ..schemas import INVENTORY
from ..sources.stock import (
    CHANGES, PARTS, files_of, inventory_version, line_of, part_of, read_inventory_snapshot,
)

FOLD_AFTER = 8  # changes of a part that a reader merges before they are folded


def _commit(
    spark: SparkSession, root: str, version: str, parent: str | None, kind: str, parts: int,
    held: Iterable[int],
) -> str:
    """Makes a version visible. The commit of a child is a folder named after its parent,
    which only one writer can make."""
    commit = spark.range(1).select(
        F.lit(version).alias("version"),
        F.lit(parent).cast("string").alias("parent"),
        F.current_timestamp().alias("committed_at"),
        F.lit(kind).alias("kind"),
        F.lit(parts).cast("int").alias("parts"),
        F.lit(",".join(map(str, sorted(held)))).alias("held"),
    )
    if parent is None:
        commit.write.parquet(f"{root}/commits/of={version}")
        return version
    if inventory_version(spark, root) != parent:
        raise ValueError(f"{root}: another snapshot was committed after {parent}")
    try:
        commit.write.mode("error").parquet(f"{root}/commits/after={parent}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError(f"{root}: another snapshot was committed after {parent}") from error
    return version


def _write_parts(rows: DataFrame, path: str, parts: int) -> set[int]:
    """Files of each part of the key range, as many as its rows fill; returns the parts."""
    placed = rows.withColumn("part", part_of(parts))
    placed.hint("rebalance", "part").write.partitionBy("part").parquet(path)
    files = rows.sparkSession.read.schema(INVENTORY).parquet(path).inputFiles()
    return {int(file.rpartition("/part=")[2].split("/")[0]) for file in files if "/part=" in file}


def write_inventory(
    inventory: DataFrame, root: str, parent: str | None = None, parts: int = PARTS
) -> str:
    """Store a new snapshot under ``root`` and commit it; returns its version.

    Readers follow the commit log, so a snapshot that was only partly written
    is never seen and the one being read is never overwritten. ``parent`` is the
    version that the snapshot was made from: where another one has been committed
    since, its changes would be lost, so the commit is refused.
    """
    version = uuid4().hex
    rows = inventory.select(*INVENTORY.fieldNames())
    held = _write_parts(rows, f"{root}/data/version={version}", parts)
    return _commit(inventory.sparkSession, root, version, parent, "base", parts, held)


def append_changes(changes: DataFrame, root: str, parent: str) -> str:
    """Commits changed SKUs (columns of ``CHANGES``, one row a SKU) on top of ``parent``."""
    spark, version = changes.sparkSession, uuid4().hex
    parts = line_of(spark, root, parent)[-1].parts
    held = _write_parts(changes.select(*CHANGES.fieldNames()), f"{root}/deltas/version={version}", parts)
    return _commit(spark, root, version, parent, "delta", parts, held)


def correct_inventory(
    spark: SparkSession, root: str, updates: DataFrame, *, order_by: str = "updated_at",
    default_lead: int = NEW_SKU_LEAD_TIME,
) -> str:
    """Stock corrections as a version on top of the last one; the rules of ``upsert_stock``.

    Only the corrected SKUs are written, and only the parts that hold them are read.
    """
    parent = inventory_version(spark, root)
    parts = line_of(spark, root, parent)[-1].parts
    last = last_corrections(updates, order_by).persist()
    touched = [row[0] for row in last.select(part_of(parts)).distinct().collect()]
    stocked = read_inventory_snapshot(spark, root, parent, touched)
    known = one_per_sku(stocked.join(last.select(*SKU), [*SKU], "left_semi"))
    known = known.withColumn("known", F.lit(True)).drop("current_stock")
    lead = F.when(F.col("known"), F.col("lead_time_days")).otherwise(F.lit(default_lead))
    changes = last.join(known, [*SKU], "left").select(
        *SKU, F.col("new_stock").alias("current_stock"), lead.cast("int").alias("lead_time_days"),
        F.lit(False).alias("delisted"),
    )
    version = append_changes(changes, root, parent)
    last.unpersist()
    return version


def delist(skus: DataFrame, root: str, parent: str) -> str:
    """Takes SKUs out of stock as a version on top of ``parent``."""
    gone = skus.select(*SKU).distinct().select(
        *SKU, F.lit(None).cast("int").alias("current_stock"),
        F.lit(None).cast("int").alias("lead_time_days"), F.lit(True).alias("delisted"),
    )
    return append_changes(gone, root, parent)


def fold_inventory(spark: SparkSession, root: str, after: int = FOLD_AFTER) -> str | None:
    """New base files for the parts with ``after`` changes or more; the stock stays the same.

    Other parts are neither read nor written. Returns the version, None if nothing was due.
    """
    version = inventory_version(spark, root)
    line = line_of(spark, root, version)
    _, changes = files_of(line)
    times = Counter(int(path.rpartition("=")[2]) for path in changes)
    due = {part for part, n in times.items() if n >= after}
    if not due:
        return None
    folded = uuid4().hex
    rows = read_inventory_snapshot(spark, root, version, due)
    _write_parts(rows, f"{root}/data/version={folded}", line[-1].parts)
    return _commit(spark, root, folded, version, "fold", line[-1].parts, due)
