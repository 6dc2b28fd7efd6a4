"""Row filters of the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import ALL, AT_RISK, FEATURES
from ..functions.text import contains_text


def by_action(decisions: DataFrame, action: str) -> DataFrame:
    return decisions.filter(F.col("action") == action)


def by_stock_out_risk(decisions: DataFrame, risk: str) -> DataFrame:
    return decisions.filter(F.col("stock_out_risk") == risk)


def at_risk(health: DataFrame) -> DataFrame:
    return health.filter(F.col("risk_level").isin(*AT_RISK))


def for_store(rows: DataFrame, store: str) -> DataFrame:
    return rows.filter(F.col("store_id") == store)


def filter_skus(rows: DataFrame, store: str = "", product: str = "", risk: str = ALL) -> DataFrame:
    """Substring on store and product, equality on risk; empty and ``ALL`` keep all."""
    if store:
        rows = rows.filter(contains_text(F.col("store_id"), store))
    if product:
        rows = rows.filter(contains_text(F.col("product_id"), product))
    if risk != ALL:
        rows = rows.filter(F.col("risk_level") == risk)
    return rows


def reorder_queue(
    rows: DataFrame, store: str = "", product: str = "", risk: str = ALL
) -> DataFrame:
    """As :func:`filter_skus`, but ``ALL`` means the at-risk tiers."""
    return filter_skus(at_risk(rows) if risk == ALL else rows, store, product, risk)


def search(rows: DataFrame, text: str) -> DataFrame:
    """Substring of "store product date"."""
    return rows.filter(contains_text(F.concat_ws(" ", "store_id", "product_id", "date"), text))


def drop_null_features(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=[*FEATURES])
