"""Sorts, top-k lists and pages. Every order ends in a key, so results are stable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import ACTIONS, DEMAND_ROWS, PAGE_SIZE, SKU, TOP_AT_RISK
from .filters import at_risk, for_store


def sort_decisions(decisions: DataFrame, *, by_priority: bool = False) -> DataFrame:
    """Action, then risk, both descending as text, then SKU.

    As text REORDER comes first but NO_ACTION before MONITOR;
    ``by_priority`` puts MONITOR second.
    """
    if by_priority:
        rank = F
        for place, name in enumerate(ACTIONS):
            rank = rank.when(F.col("action") == name, F.lit(place))
        return decisions.orderBy(rank, *SKU)
    return decisions.orderBy(F.desc("action"), F.desc("stock_out_risk"), *SKU)


def top_at_risk(health: DataFrame, n: int = TOP_AT_RISK) -> DataFrame:
    """The at-risk SKUs that run out first."""
    return (
        at_risk(health)
        .orderBy("days_of_cover", *SKU)
        .limit(n)
        .select(*SKU, "days_of_cover", "risk_level")
    )


def first_rows(rows: DataFrame, limit: int = DEMAND_ROWS, keys: Sequence[str] = SKU) -> DataFrame:
    return rows.orderBy(*keys).limit(limit)


def page(
    rows: DataFrame, number: int, size: int = PAGE_SIZE, keys: Sequence[str] = SKU
) -> DataFrame:
    """Page ``number``, counted from 0.

    Every task keeps all rows up to the page's end, so this is for the first
    pages of a report; :func:`page_after` costs the same at any depth.
    """
    return rows.orderBy(*keys).offset(number * size).limit(size)


def page_after(
    rows: DataFrame, last: Sequence[object], size: int = PAGE_SIZE, keys: Sequence[str] = SKU
) -> DataFrame:
    """The page that follows the key ``last``."""
    behind = F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, last)])
    # Implied by the comparison above, but this one can be pushed into a scan.
    reached = F.col(keys[0]) >= F.lit(last[0])
    return rows.filter(reached & behind).orderBy(*keys).limit(size)


def page_count(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.ceil(F.count("*") / size).cast("bigint").alias("pages")
    )


def last_days(series: DataFrame, n: int = 7) -> DataFrame:
    """The ``n`` calendar days that end at the last date; one row a day.

    The ``n`` largest dates hold all of these days, so the series is planned once.
    """
    ends = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    largest = series.orderBy(F.desc("date")).limit(n).withColumn("last", F.first("date").over(ends))
    return largest.filter(F.to_date("date") > F.date_sub(F.to_date("last"), n)).drop("last")


def recent_windows(windows: DataFrame, store: str, n: int = 10) -> DataFrame:
    """The latest windows of one store."""
    return for_store(windows, store).orderBy(F.desc("window_start"), "product_id").limit(n)
