"""One schema per relation, built without a session."""

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

_TYPES = {
    "bigint": LongType(),
    "boolean": BooleanType(),
    "date": DateType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "string": StringType(),
    "timestamp": TimestampType(),
}


def schema(columns: str) -> StructType:
    """``"name type, ..."`` as nullable columns."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


def extended(base: StructType, columns: str) -> StructType:
    """A new schema: ``base`` and more columns."""
    return StructType([*base.fields, *schema(columns).fields])


SALES_EVENT = schema(
    "event_time string, store_id string, product_id string, category string, "
    "unit_price double, quantity int, payment_mode string, is_anomaly boolean"
)

WINDOWED = schema(
    "window_start timestamp, window_end timestamp, store_id string, product_id string, "
    "total_units_sold bigint, total_revenue double, avg_units_per_minute double, "
    "transaction_count bigint"
)

INVENTORY = schema(
    "store_id string, product_id string, current_stock int, lead_time_days int"
)

SELLERS = schema(
    "store_id string, product_id string, seller_name string, seller_contact string, "
    "auto_confirm_eligible string"
)

STOCK_UPDATES = schema(
    "store_id string, product_id string, current_stock int, updated_at timestamp"
)

SKU_FEATURES = schema(
    "store_id string, product_id string, total_units_sold bigint, total_revenue double, "
    "avg_units_per_minute double, transaction_count bigint"
)

DECISIONS = schema(
    "store_id string, product_id string, current_stock int, predicted_daily_demand double, "
    "stock_out_risk string, recommended_reorder_quantity double, action string"
)

RUNS = schema(
    "status string, last_run timestamp, model_version string, rmse double, r2 double, "
    "mae double, error string, recorded_at timestamp"
)

DAILY = schema(
    "day date, store_id string, product_id string, units bigint, revenue double, demand double"
)
ROLLED = schema("day date, files string, rolled_at timestamp")

# A micro-batch as reported; ``quality`` are observed counts as a JSON object.
PROGRESS = schema(
    "query_id string, batch_id bigint, reported_at string, rows_in bigint, late bigint, "
    "state_rows bigint, watermark string, quality string"
)

COMMITS = schema(
    "version string, parent string, committed_at timestamp, kind string, parts int, held string"
)
