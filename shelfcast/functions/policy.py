"""Demand, cover, risk and reorder rules as column expressions."""

from pyspark.sql import Column, functions as F

from ..config import StockPolicy, WindowSpec
from .numbers import round0, round2, truncate

_POLICY = StockPolicy()


def daily_demand_from_prediction(prediction: Column, spec: WindowSpec) -> Column:
    """Units per window scaled to a day."""
    return round2(prediction * F.lit(spec.windows_per_day))


def daily_demand_from_rate(units_per_minute: Column) -> Column:
    """Units per minute scaled to a day."""
    return round2(units_per_minute * 60 * 24)


def daily_demand_from_units(units: Column, spec: WindowSpec) -> Column:
    """As the rate form, but from the unrounded units of one window.

    The stored rate has two decimals, which is a step of 14.4 units a day and
    rounds slow sellers in long windows to zero.
    """
    return round2((units * 86400).cast("double") / F.lit(float(spec.window_seconds)))


def blended_demand(model: Column, streaming: Column) -> Column:
    """The higher of both estimates, never below zero."""
    return F.greatest(model, F.lit(0.0), streaming)


def days_of_cover(stock: Column, demand: Column) -> Column:
    """Days the stock lasts; demand below one unit a day counts as one."""
    return round2(stock / F.greatest(demand, F.lit(1.0)))


def risk_level(cover: Column, policy: StockPolicy = _POLICY) -> Column:
    """Four tiers, cut on the already rounded days of cover."""
    return (
        F.when(cover <= policy.critical_days, "CRITICAL")
        .when(cover <= policy.high_days, "HIGH")
        .when(cover <= policy.medium_days, "MEDIUM")
        .otherwise("LOW")
    )


def stock_out_risk(
    stock: Column, demand: Column, lead: Column, policy: StockPolicy = _POLICY
) -> Column:
    """Three tiers by lead time; an unknown stock is LOW."""
    return (
        F.when(stock < demand * lead, "HIGH")
        .when(stock < demand * (lead + policy.medium_slack_days), "MEDIUM")
        .otherwise("LOW")
    )


def reorder_qty_lead_time(
    stock: Column, demand: Column, lead: Column, policy: StockPolicy = _POLICY
) -> Column:
    """Shortfall against lead time plus buffer, rounded, as a double."""
    missing = demand * (lead + policy.buffer_days) - stock
    return F.when(missing > 0, round0(missing)).otherwise(F.lit(0.0))


def reorder_qty_cover(
    stock: Column, demand: Column, lead: Column, policy: StockPolicy = _POLICY
) -> Column:
    """Truncated target minus stock, never below zero, as a whole number."""
    target = truncate(demand * (lead + policy.buffer_days))
    return F.greatest(F.lit(0).cast("bigint"), target - stock)


def action(risk: Column) -> Column:
    return (
        F.when(risk == "HIGH", "REORDER").when(risk == "MEDIUM", "MONITOR").otherwise("NO_ACTION")
    )
