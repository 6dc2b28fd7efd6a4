"""Keys, flags, matching, categories and dates as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from ..constants import CATEGORY_RANGES, OTHER_CATEGORY, OTHER_PRICE_CEILING, PRICE_CEILINGS


def sku_key(store: Column, product: Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, store, product)


def text_flag(c: Column) -> Column:
    """``" True "`` -> true; anything but "true" -> false; null -> null."""
    return F.lower(F.trim(c)) == "true"


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive substring test; the empty text matches everything."""
    return F.lower(c).contains(text.lower())


def category_of(product: Column) -> Column:
    """Category by the number at the end of the product id."""
    number = F.regexp_extract(product, r"_(\d+)$", 1).try_cast("int")
    out = F
    for low, high, name in CATEGORY_RANGES:
        out = out.when(number.between(low, high), F.lit(name))
    return out.otherwise(F.lit(OTHER_CATEGORY))


def price_ceiling(category: Column) -> Column:
    """Highest regular price of a category."""
    out = F
    for name, high in PRICE_CEILINGS.items():
        out = out.when(category == name, F.lit(high))
    return out.otherwise(F.lit(OTHER_PRICE_CEILING))


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def version_stamp(prefix: str, ts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def date_spine(end: date | Column, days: int) -> Column:
    """Array of ``days`` dates that ends at ``end``."""
    last = end if isinstance(end, Column) else F.lit(end)
    return F.sequence(F.date_sub(last, days - 1), last)
