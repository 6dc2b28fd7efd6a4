"""Retail relations derived from the driver tables, every row of them.

The tables hold no retail stream, so sales come from ``events`` (dense in
time, few SKUs) and from ``lineitem`` (many SKUs, one-day grain). The same
formulas stand as SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import category_of
from ..schemas import INVENTORY, SELLERS, STOCK_UPDATES


SLICE_FILES = 8  # tasks that write, and read, a slice of the sales stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, number: Column) -> Column:
    """``STORE_001``; longer numbers keep all their digits."""
    padded = F.when(number < 10, prefix + "00").when(number < 100, prefix + "0").otherwise(prefix)
    return F.concat(padded, number.cast("string"))


def store_id(number: Column) -> Column:
    return _id("STORE_", number)


def product_id(number: Column) -> Column:
    return _id("PROD_", number)


def _store_of(user: Column) -> Column:
    return user % 5 + 1


def _product_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint") % 50 + 1


def _sale_columns() -> dict[str, Column]:
    n = F.col("event_id")
    product = product_id(_product_of(F.col("props")))
    return {
        "event_time": F.col("ts").cast("timestamp"),
        "store_id": store_id(_store_of(F.col("user_id"))),
        "product_id": product,
        "category": category_of(product),
        "unit_price": F.col("value"),
        "quantity": F.when(n % 97 == 0, 0).otherwise(n % 5 + 1).cast("int"),
        "payment_mode": F.when(n % 3 == 0, "UPI").when(n % 3 == 1, "Card").otherwise("Cash"),
        "is_anomaly": F.col("event_type") == "error",
    }


def sales_of(events: DataFrame) -> DataFrame:
    """Sales rows of ``events`` rows, batch or streaming; some are not valid."""
    return events.select(*[c.alias(name) for name, c in _sale_columns().items()])


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_of(table(spark, sf_dir, "events"))


def event_slices(spark: SparkSession, sf_dir: str, slices: int, late: bool = False) -> list[DataFrame]:
    """All ``events`` in equal spans of time; ``late`` keeps a tenth of the first for the last."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.unix_micros(F.min(_ts())), F.unix_micros(F.max(_ts()))).first()
    at = F.least(
        F.floor((F.unix_micros(_ts()) - first) * slices / (last - first + 1)), F.lit(slices - 1)
    )
    if late:
        at = F.when((at == 0) & (F.col("event_id") % 10 == 0), F.lit(slices - 1)).otherwise(at)
    return [events.filter(at == i) for i in range(slices)]


def _ts() -> Column:
    return F.col("ts").cast("timestamp")


def append_slice(events: DataFrame, folder: str) -> None:
    """The files of one more micro-batch in the folder of a stream.

    Rows are dealt to the tasks in turn, and no task of a slice with so many rows or more
    is without one: each slice has the same number of files.
    """
    events.repartition(SLICE_FILES).write.mode("append").parquet(folder)


def sales_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The files of a folder as a stream of sales, one slice a micro-batch."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    return sales_of(reader.option("maxFilesPerTrigger", SLICE_FILES).parquet(folder))


def event_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The sales as JSON text, with broken lines of every kind in between; ``keep`` are
    columns that say where a line came from."""
    n, sale = F.col("event_id"), _sale_columns()
    stamp = F.date_format(sale["event_time"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    sale["event_time"] = F.when(n % 83 == 2, "garbage").when(n % 71 != 5, stamp)
    sale["store_id"] = F.when(n % 101 != 6, sale["store_id"])
    sale["unit_price"] = F.when(n % 67 == 6, -sale["unit_price"]).otherwise(sale["unit_price"])
    whole = F.to_json(F.struct(*[c.alias(name) for name, c in sale.items()]))
    origin = [F.col("event_id").alias(name) for name in keep]
    rows = table(spark, sf_dir, "events").select("event_id", *origin, whole.alias("text"))
    text = F.col("text")
    quoted = F.regexp_replace(text, r'"unit_price":([^,]+)', r'"unit_price":"$1"')
    halves = F.regexp_replace(text, r'"quantity":\d+', '"quantity":1.5')
    cut = F.substring(text, F.lit(1), F.length(text) - 9)
    line = F.when(n % 89 == 1, cut).when(n % 73 == 4, quoted).when(n % 79 == 3, halves)
    for modulus, rest, number in ((59, 8, "NaN"), (61, 9, "Infinity"), (53, 10, "1e400")):
        strange = F.regexp_replace(text, r'"unit_price":[^,]+', f'"unit_price":{number}')
        line = line.when(n % modulus == rest, strange)
    line = line.when(n % 103 == 11, "{}").when(n % 107 == 12, '{"unit_price": 5}')
    return rows.select(line.otherwise(text).alias("value"), *keep)


def sales_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        store_id(F.col("l_suppkey")).alias("store_id"),
        product_id(F.col("l_partkey")).alias("product_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def _stocked(skus: DataFrame) -> DataFrame:
    store, product = F.col("store"), F.col("product")
    return skus.select(
        store_id(store).alias("store_id"),
        product_id(product).alias("product_id"),
        ((product * 37 + store * 11) % 200).cast("int").alias("current_stock"),
        (2 + (product + store) % 3).cast("int").alias("lead_time_days"),
    ).to(INVENTORY)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of all SKUs in ``sales`` and of one unsold product per supplier."""
    sold = table(spark, sf_dir, "events").select(
        _store_of(F.col("user_id")).alias("store"), _product_of(F.col("props")).alias("product")
    )
    unsold = table(spark, sf_dir, "supplier").select(
        _store_of(F.col("s_suppkey")).alias("store"), (F.col("s_suppkey") + 51).alias("product")
    )
    return _stocked(sold.distinct().unionByName(unsold))


def inventory_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of all SKUs in ``sales_li``; each part is also listed at a home store."""
    sold = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("product")
    )
    listed = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 10).alias("store"), F.col("p_partkey").alias("product")
    )
    return _stocked(sold.unionByName(listed).distinct())


def unlisted() -> Column:
    """SKUs of ``inventory`` that a stream finds listed only after they have sold."""
    return (F.col("lead_time_days") == 4) & (F.col("current_stock") % 2 == 0)


def delisted_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SKUs of ``inventory_li`` that go out of stock for good."""
    return inventory_li(spark, sf_dir).filter(F.col("current_stock") % 9 == 0)


def repeated_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inventory_li`` with the SKUs of home stores listed a second time, with more stock."""
    stocked = inventory_li(spark, sf_dir)
    again = stocked.withColumn("current_stock", F.col("current_stock") + 7)
    return stocked.unionByName(again.filter(F.col("lead_time_days") == 2))


def sellers_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seller for each SKU of ``sales_li``."""
    skus = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    supplier = table(spark, sf_dir, "supplier")
    store, product = F.col("l_suppkey"), F.col("l_partkey")
    kind = (store + product) % 3
    return skus.join(supplier, store == F.col("s_suppkey")).select(
        store_id(store).alias("store_id"),
        product_id(product).alias("product_id"),
        F.col("s_name").alias("seller_name"),
        F.concat_ws("-", F.lit("desk"), store, product).alias("seller_contact"),
        F.when(kind == 0, "true").when(kind == 1, "FALSE").otherwise(" True ")
        .alias("auto_confirm_eligible"),
    ).to(SELLERS)


def stock_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock counts made of ``orders``: repeated, new, padded, blank and negative ones."""
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.when(priority == "2-HIGH", "  ").otherwise(""), store_id(F.col("o_orderkey") % 10))
        .alias("store_id"),
        F.when(priority == "5-LOW", F.lit("  "))
        .otherwise(product_id(F.col("o_custkey")))
        .alias("product_id"),
        F.when(priority == "1-URGENT", F.lit(-1))
        .otherwise(F.floor("o_totalprice") % 500)
        .cast("int")
        .alias("current_stock"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    ).to(STOCK_UPDATES)
