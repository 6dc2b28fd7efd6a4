"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows are ranked within their source in the order of a seeded hash, a row's fractional
rank is (rank - 1/2) / rows of the source, all rows are sorted by it, and the order is
cut into equal parts. So each shard gets its share of each source to within a row or two,
and row counts differ by one at most (law ``rows``). Equal texts are not kept together: a
group of copies larger than a shard can't be, under this law.

No rank needs a source in one task. The hash cuts a source into 4096 even buckets whose
counts are summed up first; a row's rank is the count of the buckets before its own plus
its place in its bucket. The fractional ranks, even by construction, are cut the same way.

Defined results: a null text counts as empty; a null source is a source of its own; rows
that agree in id, source and text are interchangeable. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 4096
LAW = "rows"


def _starts(counts: DataFrame, by: list[str], bucket: str, name: str) -> DataFrame:
    """Adds the rows of earlier buckets of the same group."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0)))


def _order(row_hash: str) -> list[Column]:
    return [F.col(row_hash), F.col("doc_id"), F.col("size"), F.col("text_crc32")]


def assign_shards(documents: DataFrame, shards: int = 24, seed: str = "0") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("unknown"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))).alias("hash"),
    ).withColumn("bucket", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    group = ["source", "unknown"]

    counts = rows.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    starts = _starts(counts, group, "bucket", "start")
    totals = counts.groupBy(*group).agg(F.sum("n").alias("of_source"))
    in_bucket = Window.partitionBy(*group, "bucket").orderBy(*_order("hash"))
    ranked = (
        rows.withColumn("place", F.row_number().over(in_bucket))
        .join(starts.join(totals, group).drop("n"), [*group, "bucket"])
        .withColumn("share", (F.col("start") + F.col("place") - 0.5) / F.col("of_source"))
        .select("doc_id", "size", "text_crc32", *group, "hash", "share")
        .withColumn("bucket", F.floor(F.col("share") * BUCKETS).cast("int"))
    )

    slices = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row for each of at most 4096 slices.
    every = _starts(slices, [], "bucket", "start").withColumn(
        "rows", F.sum("n").over(Window.partitionBy())
    )
    in_slice = Window.partitionBy("bucket").orderBy("share", *group, *_order("hash"))
    place = F.col("start") + F.row_number().over(in_slice) - 1
    at = ranked.join(F.broadcast(every.drop("n")), "bucket").withColumn("place", place)
    at = at.withColumn("shard", F.expr(f"place * {shards} div rows").cast("int"))
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
