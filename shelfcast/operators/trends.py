"""Daily series and movement of SKUs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StockPolicy, WindowSpec
from ..constants import AT_RISK, SKU, TREND_BASE, TREND_STEP
from ..functions.numbers import exact_avg, exact_sum, round2
from ..functions.policy import daily_demand_from_units, days_of_cover, risk_level
from ..functions.text import date_spine, iso_date


def trend_scaffold(
    health: DataFrame, range_days: int = 7, as_of: date | None = None
) -> DataFrame:
    """Today's totals spread over ``range_days`` dates: (date, series, value).

    A display scaffold, not history: the value of a day is today's total times
    ``0.88 + 0.02 * (range_days - days ago)``. History is :func:`daily_trend`.
    """
    if range_days < 1:
        raise ValueError("range_days must be positive")
    return _scaffold(health, range_days, as_of).drop("critical")


def _scaffold(health: DataFrame, range_days: int, as_of: date | None) -> DataFrame:
    """(date, series, value, critical) from one aggregate."""
    end = F.current_date() if as_of is None else F.lit(as_of)
    totals = health.agg(
        F.coalesce(exact_sum(F.col("actual_sales")), F.lit(0.0)).alias("sales_rate"),
        F.coalesce(exact_sum(F.col("predicted_daily_demand")), F.lit(0.0)).alias("demand_rate"),
        F.count_if(F.col("risk_level").isin(*AT_RISK)).cast("double").alias("reorder_rate"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
    )
    names = ("sales_rate", "demand_rate", "reorder_rate")
    series = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("total")) for n in names])
    days = totals.select(
        F.explode(date_spine(end, range_days)).alias("day"), series.alias("all"), "critical"
    )
    factor = F.lit(TREND_BASE) + F.lit(TREND_STEP) * (range_days - F.date_diff(end, "day"))
    return days.select("day", "critical", F.inline("all")).select(
        iso_date(F.col("day")).alias("date"),
        "series",
        round2(F.col("total") * factor).alias("value"),
        "critical",
    )


def daily_skus(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Per (day, SKU): units, revenue and the demand rate of its best window.

    ``windows`` must be tumbling, otherwise units are counted repeatedly.
    """
    if not spec.is_tumbling:
        raise ValueError("daily totals need tumbling windows")
    return (
        windows.groupBy(F.to_date("window_start").alias("day"), *SKU)
        .agg(
            F.sum("total_units_sold").alias("units"),
            exact_sum(F.col("total_revenue")).alias("revenue"),
            F.max("total_units_sold").alias("best_window"),
        )
        .withColumn("demand", daily_demand_from_units(F.col("best_window"), spec))
        .drop("best_window")
    )


def daily_trend(
    windows: DataFrame, inventory: DataFrame, spec: WindowSpec, policy: StockPolicy = StockPolicy()
) -> DataFrame:
    """Real per-day units, revenue, demand and SKUs at risk against current stock."""
    return trend_of(daily_skus(windows, spec), inventory, policy)


def trend_of(
    daily: DataFrame, inventory: DataFrame, policy: StockPolicy = StockPolicy()
) -> DataFrame:
    """:func:`daily_trend` from daily totals of SKUs, computed or stored."""
    cover = days_of_cover(F.col("current_stock"), F.col("demand"))
    risky = F.coalesce(risk_level(cover, policy).isin(*AT_RISK), F.lit(False))
    risky = risky & F.col("current_stock").isNotNull()
    return (
        daily.join(inventory, [*SKU], "left")
        .groupBy("day")
        .agg(
            F.sum("units").alias("units"),
            exact_sum(F.col("revenue")).alias("revenue"),
            exact_sum(F.col("demand")).alias("demand"),
            F.count_if(risky).alias("at_risk"),
        )
        .select(iso_date(F.col("day")).alias("date"), "units", "revenue", "demand", "at_risk")
    )


def trend_kpis(health: DataFrame, range_days: int = 7, as_of: date | None = None) -> DataFrame:
    """Mean sales, mean demand, sum of reorders and the critical SKUs, in one row.

    All of them are read off the one aggregate behind :func:`trend_scaffold`.
    """
    def of(name: str) -> Column:
        return F.when(F.col("series") == name, F.col("value"))

    return _scaffold(health, range_days, as_of).agg(
        F.coalesce(exact_avg(of("sales_rate")), F.lit(0.0)).alias("avg_daily_sales"),
        F.coalesce(exact_avg(of("demand_rate")), F.lit(0.0)).alias("avg_daily_demand"),
        F.coalesce(exact_sum(of("reorder_rate")), F.lit(0.0)).alias("reorder_events_count"),
        F.max("critical").alias("critical_sku_count"),
    )


def mover_trend(
    daily: DataFrame, as_of: date, days: int = 7, tolerance: float = 0.05
) -> DataFrame:
    """``up``, ``down`` or ``stable`` per SKU: the last ``days`` against those before.

    ``daily`` comes from :func:`daily_skus`. Both periods are conditional sums
    in one hash aggregate; days without sales count as zero.
    """
    end = F.lit(as_of)
    split, start = F.date_sub(end, days), F.date_sub(end, 2 * days)
    recent = F.sum(F.when(F.col("day") > split, F.col("units")).otherwise(0))
    before = F.sum(F.when(F.col("day") <= split, F.col("units")).otherwise(0))
    change = F.col("avg_daily_sales") - F.col("previous_daily_sales")
    limit = F.col("previous_daily_sales") * tolerance
    return (
        daily.filter((F.col("day") > start) & (F.col("day") <= end))
        .groupBy(*SKU)
        .agg(
            round2(recent / days).alias("avg_daily_sales"),
            round2(before / days).alias("previous_daily_sales"),
        )
        .withColumn(
            "trend", F.when(change > limit, "up").when(change < -limit, "down").otherwise("stable")
        )
    )
