"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..workspace import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later jobs start here,
    also after a loss of executors, and Spark knows its size."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


SLICE = 256  # texts that a task holds as Python strings at a time


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that texts and what is made of them don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def keep_rows(
    documents: DataFrame, judge: Callable[[], Callable[[list[str | None]], Sequence[bool]]]
) -> DataFrame:
    """The rows whose texts are judged true, all columns; ``judge()`` is called in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in slices(batches):
            mask = [bool(kept) for kept in keep(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a document (null for no id)."""
    return F.crc32(doc_id.cast("string")) % modulus


def labelled(
    documents: DataFrame, labels: DataFrame, label: str, trains: Column, per_class: int
) -> DataFrame:
    """(doc_id, text, label int) of at most ``per_class`` training rows for each label.

    The sample is the ids with the smallest hashes, so it is the same for any partitioning.
    Labels other than 0 and 1, rows without an id, and ids labelled both 0 and 1 are left
    out; an id counts once, and of its texts the one with the smallest hash.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(trains)
    agreed = known.where("label IN (0, 1)").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("other")
    )
    picked = [
        agreed.where((F.col("label") == value) & (F.col("other") == value))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(per_class)
        for value in (0, 1)
    ]
    chosen = picked[0].unionByName(picked[1]).select("doc_id", "label")
    found = documents.select("doc_id", "text").join(chosen, "doc_id")
    return found.groupBy("doc_id", "label").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    ).select("doc_id", "text", "label")
