"""Validation, quality counts, categories and anomaly rules of sales events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..constants import ANOMALY_PRICE_FACTOR, ANOMALY_QUANTITY, SKU
from ..functions.numbers import percent
from ..functions.sales import revenue, sales_sums, sound_price
from ..functions.text import category_of, price_ceiling
from ..schemas import SALES_EVENT


def _positive(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False))


def _unreadable() -> Column:
    return F.coalesce(*[F.col(f).cast("string") for f in SALES_EVENT.fieldNames()]).isNull()


def valid_sales(events: DataFrame) -> DataFrame:
    """Price and quantity above zero and a finite amount; nulls are dropped with the rest."""
    return events.filter(sound_price() & (F.col("quantity") > 0))


def rejected_sales(events: DataFrame, *, require_time: bool = True) -> DataFrame:
    """The rows that no window will count, with the first ``reason``.

    ``bad_json``: no field could be read, as from an empty object. ``bad_time`` rows pass
    :func:`valid_sales` but have no place in time; ``require_time=False``
    leaves them out, which gives the exact complement of :func:`valid_sales`.
    """
    reason = F.when(_unreadable(), "bad_json")
    if require_time:
        reason = reason.when(F.col("event_time").isNull(), "bad_time")
    reason = reason.when(~sound_price(), "bad_price")
    reason = reason.when(~_positive("quantity"), "bad_quantity")
    return events.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The rows of ``parse_lines`` that no window will count, with their lines and a reason.

    ``bad_json`` is broken text, ``bad_field`` JSON with a field of another type than its
    column, ``no_fields`` an empty text or object; the others are those of
    :func:`rejected_sales`. Lines stay as they came, so they can be sent in again.
    """
    broken = F.col("corrupt") & (F.get_json_object("line", "$").isNull())
    reason = F.when(broken, "bad_json").when(F.col("corrupt"), "bad_field")
    reason = reason.when(_unreadable(), "no_fields").when(F.col("event_time").isNull(), "bad_time")
    reason = reason.when(~sound_price(), "bad_price").when(~_positive("quantity"), "bad_quantity")
    return parsed.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def _quality_counts() -> list[Column]:
    def rows_where(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return [
        F.count("*").alias("events"),
        rows_where(_unreadable(), "unreadable"),
        rows_where(F.col("event_time").isNull(), "null_time"),
        rows_where(F.col("store_id").isNull(), "null_store"),
        rows_where(F.col("product_id").isNull(), "null_product"),
        rows_where(F.col("unit_price").isNull(), "null_price"),
        rows_where(F.col("unit_price") <= 0, "nonpositive_price"),
        rows_where(F.col("quantity").isNull(), "null_quantity"),
        rows_where(F.col("quantity") <= 0, "nonpositive_quantity"),
        rows_where(sound_price() & _positive("quantity"), "valid"),
    ]


def event_quality(events: DataFrame) -> DataFrame:
    """One row of counts, in one pass."""
    return events.agg(*_quality_counts())


def observe_quality(events: DataFrame, observation: Observation | str) -> DataFrame:
    """The same counts as a side result of whatever the rows are used for.

    On a stream pass a name; the counts arrive with each micro-batch's progress.
    """
    return events.observe(observation, *_quality_counts())


def with_category(events: DataFrame) -> DataFrame:
    return events.withColumn("category", category_of(F.col("product_id")))


def flag_anomalies(events: DataFrame) -> DataFrame:
    """Adds ``price_spike``, ``bulk_quantity`` and their union ``rule_anomaly``."""
    spike = F.col("unit_price") >= price_ceiling(category_of(F.col("product_id"))) * ANOMALY_PRICE_FACTOR
    bulk = F.col("quantity") >= ANOMALY_QUANTITY
    return events.withColumns({"price_spike": spike, "bulk_quantity": bulk}).withColumn(
        "rule_anomaly", F.col("price_spike") | F.col("bulk_quantity")
    )


def anomaly_shares(flagged: DataFrame) -> DataFrame:
    """Per SKU: how many events the rules flag and how often the producer agrees."""
    return (
        flagged.groupBy(*SKU)
        .agg(
            F.count("*").alias("events"),
            F.count_if("rule_anomaly").alias("rule_anomalies"),
            F.count_if("is_anomaly").alias("producer_anomalies"),
            F.count_if(F.col("rule_anomaly") == F.col("is_anomaly")).alias("agreeing"),
        )
        .withColumns(
            {
                "anomaly_percent": percent(F.col("rule_anomalies"), F.col("events")),
                "agreement_percent": percent(F.col("agreeing"), F.col("events")),
            }
        )
    )


def category_sales(sales: DataFrame) -> DataFrame:
    """Units, revenue and events per category."""
    return (
        with_category(sales)
        .groupBy("category")
        .agg(*sales_sums())
        .select(
            "category",
            F.col("units").alias("total_units_sold"),
            revenue().alias("total_revenue"),
            F.col("lines").alias("transaction_count"),
        )
    )
