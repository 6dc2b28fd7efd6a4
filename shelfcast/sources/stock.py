"""Versioned stock: a base in parts of the key range, and a log of changes on top.

A version is a commit that names its parent. ``base`` holds all SKUs, ``delta`` the rows of
changed SKUs (a delisted one is marked), ``fold`` new base files of some parts with the
content that its parent has. Reading merges: for each part the newest base files in the
version's line, and the changes committed after them, of which the last row of a SKU counts.
Changes are few next to the base, which passes through without a shuffle where Spark finds
them small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import SKU
from ..schemas import COMMITS, INVENTORY, extended

CHANGES = extended(INVENTORY, "delisted boolean")
PARTS = 16


def part_of(parts: int) -> Column:
    """The part of the key range that a SKU lies in."""
    return F.pmod(F.xxhash64(*SKU), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Commit:
    version: str
    parent: str | None
    kind: str
    parts: int
    held: frozenset[int]


def inventory_version(spark: SparkSession, root: str) -> str | None:
    """The last committed version under ``root``, if there is one."""
    commits = spark.read.schema(COMMITS).option("recursiveFileLookup", True)
    try:
        return commits.parquet(f"{root}/commits").agg(F.max_by("version", "committed_at")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def line_of(spark: SparkSession, root: str, version: str | None) -> list[Commit]:
    """The commits from ``version`` back to its base; a commit is a row, a fold ends its use."""
    rows = spark.read.schema(COMMITS).option("recursiveFileLookup", True).parquet(f"{root}/commits")
    known = {row.version: row for row in rows.collect()}
    line = []
    while version is not None:
        row = known[version]
        held = frozenset(int(part) for part in row.held.split(",") if part)
        line.append(Commit(row.version, row.parent, row.kind, row.parts, held))
        version = row.parent if row.kind != "base" else None
    return line


def files_of(line: list[Commit], parts: Collection[int] | None = None) -> tuple[list[str], list[str]]:
    """The folders, below the root, of the base and of the changes that a version reads,
    of all parts or of some; changes come oldest first."""
    base, changes = [], []
    for part in sorted(range(line[-1].parts) if parts is None else parts):
        for commit in line:
            if part not in commit.held:
                continue
            if commit.kind == "delta":
                changes.append(f"deltas/version={commit.version}/part={part}")
            else:
                base.append(f"data/version={commit.version}/part={part}")
                break
    age = {commit.version: at for at, commit in enumerate(reversed(line))}
    return base, sorted(changes, key=lambda path: age[path.split("=")[1].split("/")[0]])


def _layers(
    spark: SparkSession, root: str, line: list[Commit], parts: Collection[int] | None
) -> tuple[DataFrame, DataFrame | None]:
    """The base rows of SKUs that did not change after them; the last changes, if there are any."""
    base, changes = files_of(line, parts)
    rows = spark.read.schema(INVENTORY)
    stocked = rows.parquet(*(f"{root}/{path}" for path in base)) if base else spark.createDataFrame([], INVENTORY)
    stocked = stocked.select(*INVENTORY.fieldNames())
    if not changes:
        return stocked, None
    # Grouped by the key as one struct. Dealt by the columns of the key, like the base, the union
    # of both would count as dealt so, too, and be joined as it is; but once Spark broadcasts the
    # few changes at run time it no longer is, and the job fails on unequal numbers of partitions.
    last = _last_changes(spark, root, line, changes, F.struct(*SKU).alias("sku"))
    last = last.select("sku.*", "*").select(*CHANGES.fieldNames())
    return stocked.join(last.select(*SKU), [*SKU], "left_anti"), last


def _rows_of(spark: SparkSession, root: str, line: list[Commit], parts: Collection[int] | None) -> DataFrame:
    kept, last = _layers(spark, root, line, parts)
    return kept if last is None else kept.unionByName(last.filter(~F.col("delisted")).drop("delisted"))


def _last_changes(
    spark: SparkSession, root: str, line: list[Commit], paths: list[str], *key: Column | str
) -> DataFrame:
    """The last logged values of each ``key`` of SKUs."""
    logged = spark.read.schema(extended(CHANGES, "version string")).option("basePath", f"{root}/deltas")
    rows = logged.parquet(*(f"{root}/{path}" for path in paths))
    age = F.create_map(*(F.lit(x) for at, c in enumerate(reversed(line)) for x in (c.version, at)))
    aged = rows.withColumn("age", age[F.col("version")])
    values = [F.max_by(c, "age").alias(c) for c in CHANGES.fieldNames() if c not in SKU]
    return aged.groupBy(*key).agg(*values)


def read_inventory_snapshot(
    spark: SparkSession, root: str, version: str | None, parts: Collection[int] | None = None
) -> DataFrame:
    """The stock as of a version, of all parts of the key range or of some."""
    return _rows_of(spark, root, line_of(spark, root, version), parts)


def read_inventory_version(spark: SparkSession, root: str) -> DataFrame:
    """The last committed snapshot under ``root``."""
    return read_inventory_snapshot(spark, root, inventory_version(spark, root))


def inventory_changes(spark: SparkSession, root: str, before: str, after: str) -> DataFrame:
    """The change feed between two versions: (SKU, change, old and new stock and lead time).

    ``change`` is ``new``, ``changed`` or ``delisted``; a SKU with the same values is none.
    Where ``after`` continues ``before`` only the parts and SKUs in the log between them are
    compared; a snapshot that was written whole in between is compared whole.
    """
    line = line_of(spark, root, after)
    since = next((at for at, commit in enumerate(line) if commit.version == before), None)
    values = [c for c in INVENTORY.fieldNames() if c not in SKU]
    deltas = [c for c in line[:since] if c.kind == "delta" and c.held]
    if since is None or not deltas:
        parts = None if since is None else ()
        old = _as_old(read_inventory_snapshot(spark, root, before, parts))
        new = _rows_of(spark, root, line, parts).withColumn("now", F.lit(True))
        both = old.join(new, [*SKU], "full")
    else:
        both = _logged_changes(spark, root, line, since, deltas)
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in values]
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "delisted")
    change = change.when(~(same[0] & same[1]), "changed")
    listed = F.col("was").isNotNull() | F.col("now").isNotNull()
    return both.withColumn("change", change).filter(listed & F.col("change").isNotNull()).select(
        *SKU, "change", *(c for value in values for c in (f"old_{value}", value))
    )


def _as_old(stock: DataFrame) -> DataFrame:
    values = [F.col(c).alias(f"old_{c}") for c in INVENTORY.fieldNames() if c not in SKU]
    return stock.select(*SKU, F.lit(True).alias("was"), *values)


def _logged_changes(
    spark: SparkSession, root: str, line: list[Commit], since: int, deltas: list[Commit]
) -> DataFrame:
    """The SKUs of ``deltas``, with their stock before (``was``) and after (``now``) these.

    After them a SKU is as its last row in the log says; before, as in the base or in earlier changes.
    These two are joined one after the other. A union of both would be narrowed to the logged SKUs side by
    side and count as dealt by SKU; once Spark reuses a shuffle below it no longer does, and the job fails
    on unequal numbers of partitions.
    """
    values = [c for c in INVENTORY.fieldNames() if c not in SKU]
    paths = [f"deltas/version={c.version}/part={p}" for c in deltas for p in sorted(c.held)]
    logged = _last_changes(spark, root, line, paths, *SKU).dropna(subset=[*SKU])
    held = [F.when(~F.col("delisted"), c) for c in (F.lit(True), *map(F.col, values))]
    new = logged.select(*SKU, *(c.alias(name) for c, name in zip(held, ("now", *values))))
    kept, earlier = _layers(spark, root, line[since:], {part for c in deltas for part in c.held})
    both = new.join(_as_old(kept.join(logged.select(*SKU), [*SKU], "left_semi")), [*SKU], "left")
    if earlier is None:
        return both
    names = ("was", *(f"old_{c}" for c in values))
    before = earlier.select(*SKU, *(c.alias(f"logged_{name}") for c, name in zip(held, names)))
    return both.join(before, [*SKU], "left").withColumns(
        {name: F.coalesce(name, f"logged_{name}") for name in names}
    )
