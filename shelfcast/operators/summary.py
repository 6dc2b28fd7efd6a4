"""Roll-ups of decisions, SKU health and demand rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StockPolicy
from ..constants import (
    AT_RISK, CONFIDENCE, RISK_LEVELS, SKU, TOP_MOVERS, TOP_PRODUCTS, TOP_STORES,
)
from ..functions.numbers import exact_avg, exact_sum, percent, round2
from ..functions.text import iso_date


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)


def risk_counts(decisions: DataFrame) -> DataFrame:
    return _counts(decisions, "stock_out_risk")


def action_counts(decisions: DataFrame) -> DataFrame:
    return _counts(decisions, "action")


def store_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("store_id").agg(F.count("*").alias("count")).orderBy("store_id")


def reorder_totals(decisions: DataFrame) -> DataFrame:
    """Units to reorder and mean daily demand over all decisions; null when empty."""
    return decisions.agg(
        exact_sum(F.col("recommended_reorder_quantity")).alias("total_reorder_units"),
        round2(exact_avg(F.col("predicted_daily_demand"))).alias("avg_daily_demand"),
    )


def top_reorder_stores(decisions: DataFrame, n: int = TOP_STORES) -> DataFrame:
    total = exact_sum(F.col("recommended_reorder_quantity")).alias("total_reorder")
    return (
        decisions.groupBy("store_id").agg(total).orderBy(F.desc("total_reorder"), "store_id").limit(n)
    )


def top_demand_products(decisions: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    total = exact_sum(F.col("predicted_daily_demand")).alias("total_demand")
    return (
        decisions.groupBy("product_id")
        .agg(total)
        .orderBy(F.desc("total_demand"), "product_id")
        .limit(n)
    )


def row_counts(rows: DataFrame, **subsets: Column) -> DataFrame:
    """Size of a table and of named subsets, in one pass."""
    return rows.agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in subsets.items()]
    )


def _at_risk() -> Column:
    return F.count_if(F.col("risk_level").isin(*AT_RISK))


def home_kpis(health: DataFrame, policy: StockPolicy = StockPolicy()) -> DataFrame:
    """Stock on hand, SKUs at risk, sales value and stock-out percentage."""
    value = exact_sum(F.col("actual_sales")) * F.lit(policy.unit_price)
    return health.agg(
        F.coalesce(F.sum("current_stock"), F.lit(0)).alias("total_inventory_units"),
        _at_risk().alias("at_risk_products"),
        F.coalesce(round2(value), F.lit(0.0)).alias("today_sales_revenue"),
        percent(_at_risk(), F.count("*")).alias("stockout_risk_percent"),
    )


def risk_distribution(health: DataFrame) -> DataFrame:
    """One row with the count of every tier, zero included."""
    return health.agg(*[F.count_if(F.col("risk_level") == t).alias(t) for t in RISK_LEVELS])


def inventory_health(health: DataFrame) -> DataFrame:
    return health.select(
        *SKU, "current_stock", "predicted_daily_demand", "days_of_cover", "risk_level"
    )


def demand_rows(health: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Demand columns stamped with one time, now by default."""
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return health.select(
        stamp.alias("timestamp"), *SKU, "predicted_daily_demand", "actual_sales"
    )


def prediction_rows(demand: DataFrame) -> DataFrame:
    """Demand rows as (date, predicted, actual) with the constant confidence."""
    return demand.select(
        *SKU,
        iso_date(F.col("timestamp")).alias("date"),
        F.col("predicted_daily_demand").alias("predicted_demand"),
        F.col("actual_sales").alias("actual_demand"),
        F.lit(CONFIDENCE).alias("confidence"),
    )


def _whole(c: Column) -> Column:
    return F.floor(c + 0.5)


def daily_predicted_vs_actual(predictions: DataFrame) -> DataFrame:
    """Per date the mean predicted and actual demand, as whole numbers.

    Unknown actuals are left out; a date without any has a null.
    """
    return (
        predictions.groupBy("date")
        .agg(
            _whole(exact_avg(F.col("predicted_demand"))).alias("predicted"),
            _whole(exact_avg(F.col("actual_demand"))).alias("actual"),
        )
        .orderBy("date")
    )


def top_movers(predictions: DataFrame, n: int = TOP_MOVERS) -> DataFrame:
    """The SKUs with the highest mean of actual demand, else of predicted demand."""
    units = F.coalesce("actual_demand", "predicted_demand")
    return (
        predictions.groupBy(*SKU)
        .agg(exact_avg(units).alias("avg_daily_sales"))
        .orderBy(F.desc("avg_daily_sales"), *SKU)
        .limit(n)
    )
