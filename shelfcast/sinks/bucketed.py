"""Tables bucketed by SKU: joined and grouped on it without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..constants import SKU

BUCKETS = 64
STORED_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def write_bucketed(
    rows: DataFrame, name: str, path: str, buckets: int = BUCKETS, *, sort: tuple[str, ...] = SKU
) -> DataFrame:
    """Stores rows as the catalogue table ``name`` under ``path``, bucketed and sorted by SKU.

    Tables with the same number of buckets are joined on the SKU, and grouped by it, bucket
    by bucket: choose it once for windows, stock and sellers, so that a bucket of the largest
    fits a task. Rows are dealt by SKU before the write, so a bucket is one file, and the
    session is told to rely on the order of such files (Spark does so only where a bucket
    is a single one): joins read buckets in step and don't sort them again. A SKU lies in
    one bucket whole: for windows of very hot SKUs store their ``sku_features``, which have
    one row a SKU.
    """
    rows.sparkSession.conf.set(STORED_ORDER, "true")
    dealt = rows.repartition(buckets, *SKU)
    writer = dealt.write.bucketBy(buckets, *SKU).sortBy(*sort).option("path", path)
    writer.mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)
