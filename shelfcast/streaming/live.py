"""The last state of each key, as a stream leaves it: snapshots and a short tail of batches.

Every micro-batch writes its changed rows to a directory of its own, which a replay
overwrites. Every ``FOLD_EVERY`` batches the tail is folded into snapshots, one for each
part that changed (a date, a range of keys), in as many files as its rows fill, and committed; then the batches that the fold
before had covered are deleted. So a reader touches one snapshot of each part and a tail of
fewer than ``2 * FOLD_EVERY`` batches, however long the stream has run, and a fold rewrites
only the parts that changed.

A path belongs to one checkpoint: batch numbers of another mean something else, so a
foreign checkpoint is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..schemas import extended, schema

BATCH = "batch_id"
FOLD_EVERY = 20
KEY_RANGES = 16
FILE_ROWS = 2_000_000  # of a snapshot's file, and of the task that writes it
_COMMITS = schema("part string, upto bigint")


def key_range(*keys: str) -> Column:
    """One of a fixed number of parts for tables without a date."""
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_RANGES)).cast("string")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _rows(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def _snapshots(spark: SparkSession, path: str, before: int | None = None) -> dict[str, list[int]]:
    """part -> numbers of its committed snapshots, oldest first; a row a part and fold."""
    commits = _rows(spark, f"{path}/commits", _COMMITS)
    if before is not None:
        commits = commits.filter(F.col("upto") < before)
    return {
        row.part: sorted(row.folds)
        for row in commits.groupBy("part").agg(F.collect_set("upto").alias("folds")).collect()
    }


def _state(
    spark: SparkSession, path: str, columns: StructType, newest: dict[str, int]
) -> DataFrame:
    paths = [f"{path}/snapshots/upto={upto}/part={part}" for part, upto in newest.items()]
    if not paths:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*paths)


def _tail(spark: SparkSession, path: str, columns: StructType, after: int) -> DataFrame:
    rows = _rows(spark, f"{path}/tail", extended(columns, f"{BATCH} bigint"))
    return rows.filter(F.col(BATCH) > after)


def _last_of(rows: DataFrame, columns: StructType, keys: Sequence[str]) -> DataFrame:
    newest = [F.max_by(c, BATCH).alias(c) for c in columns.fieldNames() if c not in keys]
    return rows.groupBy(*keys).agg(*newest).select(*columns.fieldNames())


def read_live(
    spark: SparkSession, path: str, columns: StructType, keys: Sequence[str],
    before: int | None = None,
) -> DataFrame:
    """One row per key, as its last batch left it, or the last one ``before`` a batch: so a
    step reads the same state when its batch is replayed, whatever it had written."""
    folds = _snapshots(spark, path, before)
    after = max((f[-1] for f in folds.values()), default=-1)
    state = _state(spark, path, columns, {part: f[-1] for part, f in folds.items()})
    tail = _tail(spark, path, columns, after)
    if before is not None:
        tail = tail.filter(F.col(BATCH) < before)
    rows = state.withColumn(BATCH, F.lit(-1).cast("bigint")).unionByName(tail)
    return _last_of(rows, columns, keys)


def shared(rows: DataFrame, part: str, keys: Sequence[str], file_rows: int) -> DataFrame:
    """The rows with one task for each file: a part is cut, by a hash of its keys, into as
    many shares as it holds times ``file_rows``.

    A streaming session runs without adaptive execution, so the shares are counted here; that
    reads ``rows`` once more. There is a count for each part, not for each key.
    """
    counts = rows.groupBy(part).count().collect()
    files = {row[0]: -(-row[1] // file_rows) for row in counts}
    if not files:
        return rows
    first, total = {}, 0
    for name, number in files.items():
        first[name], total = total, total + number

    def of(numbers: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))[F.col(part)]

    share = F.pmod(F.xxhash64(*keys), of(files))
    return rows.repartitionById(total, (of(first) + share).cast("int"))


def live_writer(
    path: str, columns: StructType, keys: Sequence[str], part: Column, fold_every: int = FOLD_EVERY,
    file_rows: int = FILE_ROWS,
) -> Callable[[DataFrame, int], None]:
    """The step of a ``foreachBatch`` that keeps the table under ``path``."""

    def fold(spark: SparkSession, upto: int) -> None:
        folds = _snapshots(spark, path, before=upto)
        after = max((f[-1] for f in folds.values()), default=-1)
        changed = _tail(spark, path, columns, after).filter(F.col(BATCH) <= upto)
        changed = changed.withColumn("part", part.cast("string"))
        parts = [row.part for row in changed.select("part").distinct().collect()]
        old = _state(spark, path, columns, {p: folds[p][-1] for p in parts if p in folds})
        rows = old.withColumn(BATCH, F.lit(-1).cast("bigint")).unionByName(changed.drop("part"))
        state = _last_of(rows, columns, keys).withColumn("part", part.cast("string"))
        shared(state, "part", keys, file_rows).write.mode("overwrite").partitionBy("part").parquet(
            f"{path}/snapshots/upto={upto}"
        )
        committed = spark.createDataFrame([(p,) for p in parts], "part string")
        committed.write.mode("overwrite").parquet(f"{path}/commits/upto={upto}")
        # What the fold before had replaced; its readers have had a whole fold to finish.
        for batch in range(max(0, after - fold_every + 1), after + 1):
            _delete(spark, f"{path}/tail/{BATCH}={batch}")
        for p in parts:
            for old_fold in folds.get(p, [])[:-1]:
                _delete(spark, f"{path}/snapshots/upto={old_fold}/part={p}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*columns.fieldNames()).write.mode("overwrite").parquet(
            f"{path}/tail/{BATCH}={batch_id}"
        )
        if (batch_id + 1) % fold_every == 0:
            fold(batch.sparkSession, batch_id)

    return write


def _line(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and row[0]


def claimed(
    spark: SparkSession, path: str, checkpoint: str, start: Callable[[], StreamingQuery]
) -> StreamingQuery:
    """Starts a query that writes to ``path``, unless another checkpoint's query has done so."""
    owner, own = _line(spark, f"{path}/owner"), _line(spark, f"{checkpoint}/metadata")
    if owner is not None and owner != own:
        raise ValueError(f"{path} belongs to another checkpoint than {checkpoint}")
    query = start()
    if owner is None:
        line = spark.createDataFrame([(_line(spark, f"{checkpoint}/metadata"),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/owner")
    return query
