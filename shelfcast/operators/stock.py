"""Sellers and stock corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    NEW_SKU_LEAD_TIME, SELLER_CONTACT_UNMAPPED, SELLER_NAME_UNMAPPED, SKU,
)
from ..functions.text import text_flag


def with_sellers(skus: DataFrame, sellers: DataFrame) -> DataFrame:
    """Seller name, contact and auto-confirm flag, with defaults for unmapped SKUs.

    ``sellers`` has one row per SKU (see ``read_sellers``). It may be as long
    as the catalogue, so no broadcast is forced.
    """
    return skus.join(sellers, [*SKU], "left").withColumns(
        {
            "seller_name": F.coalesce("seller_name", F.lit(SELLER_NAME_UNMAPPED)),
            "seller_contact": F.coalesce("seller_contact", F.lit(SELLER_CONTACT_UNMAPPED)),
            "auto_confirm_eligible": F.coalesce(
                text_flag(F.col("auto_confirm_eligible")), F.lit(False)
            ),
        }
    )


def _judged_updates(updates: DataFrame) -> DataFrame:
    """Ids without outer spaces, and why a correction is refused (null: it is not)."""
    trimmed = updates.withColumns({name: F.trim(name) for name in SKU})

    def lacks(name: str) -> Column:
        return F.coalesce(F.length(name) == 0, F.lit(True))

    reason = F.when(lacks("store_id"), "no_store").when(lacks("product_id"), "no_product")
    sound = F.coalesce(F.col("current_stock") >= 0, F.lit(False))
    return trimmed.withColumn("reason", reason.when(~sound, "bad_stock"))


def valid_updates(updates: DataFrame) -> DataFrame:
    """Both ids given, without outer spaces, and a stock of zero or more."""
    return _judged_updates(updates).filter(F.col("reason").isNull()).drop("reason")


def rejected_updates(updates: DataFrame) -> DataFrame:
    """The other corrections, each with its first ``reason``."""
    return _judged_updates(updates).filter(F.col("reason").isNotNull())


def one_per_sku(inventory: DataFrame) -> DataFrame:
    """A snapshot with one row per SKU.

    Of repeated rows the lowest stock and the longest lead time stay: the cautious
    reading, and the same for any order of rows.
    """
    return inventory.groupBy(*SKU).agg(
        F.min("current_stock").alias("current_stock"), F.max("lead_time_days").alias("lead_time_days")
    )


def last_corrections(updates: DataFrame, order_by: str = "updated_at") -> DataFrame:
    """(SKU, new_stock): the correction of each SKU that counts, see :func:`upsert_stock`."""
    # Two hash aggregates: the highest stock of each moment, then the last moment.
    moments = valid_updates(updates).groupBy(*SKU, order_by).agg(F.max("current_stock").alias("stock"))
    dated = F.col(order_by).isNotNull()
    return moments.groupBy(*SKU).agg(
        F.coalesce(
            F.max_by("stock", order_by), F.max(F.when(~dated, F.col("stock")))
        ).alias("new_stock")
    )


def upsert_stock(
    inventory: DataFrame, updates: DataFrame, *, order_by: str = "updated_at",
    default_lead: int = NEW_SKU_LEAD_TIME,
) -> DataFrame:
    """The snapshot after a batch of corrections, with a ``status`` per SKU.

    Of several corrections of one SKU the one with the highest ``order_by``
    counts (of equals the highest stock; null comes first). Known SKUs keep their
    lead time, new ones get ``default_lead``. ``status`` is ``updated``, ``created``
    or ``unchanged``; drop it before the snapshot is written. The result has one row
    per SKU, see :func:`one_per_sku`.
    """
    last = last_corrections(updates, order_by)
    known = one_per_sku(inventory).withColumn("known", F.lit(True))
    return known.join(last, [*SKU], "full").select(
        *SKU,
        F.coalesce("new_stock", "current_stock").alias("current_stock"),
        F.when(F.col("known"), F.col("lead_time_days"))
        .otherwise(F.lit(default_lead))
        .alias("lead_time_days"),
        F.when(F.col("new_stock").isNull(), "unchanged")
        .when(F.col("known"), "updated")
        .otherwise("created")
        .alias("status"),
    )


def repeated_skus(inventory: DataFrame) -> DataFrame:
    """Keys that are not unique; empty for a sound snapshot."""
    return inventory.groupBy(*SKU).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
