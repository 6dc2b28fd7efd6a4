"""Sums over sales lines."""

from pyspark.sql import Column, functions as F

from .numbers import round2, total_of, whole_and_micros

# Amounts from here on are no sales; below it a group of nine lines or more still adds up.
MAX_AMOUNT = 1e18
SUMS = ("units", "amount", "micros", "lines")


def sales_sums() -> list[Column]:
    """Units, amount (whole and millionths, see ``exact_sum``) and line count."""
    whole, micros = whole_and_micros(F.col("quantity") * F.col("unit_price"))
    return [
        F.sum("quantity").alias("units"),
        F.try_sum(whole).alias("amount"),
        F.sum(micros).alias("micros"),
        F.count("*").alias("lines"),
    ]


def merged_sums() -> list[Column]:
    """Sums of sums."""
    return [merged_sum(name).alias(name) for name in SUMS]


def merged_sum(name: str) -> Column:
    return (F.try_sum if name == "amount" else F.sum)(name)


def revenue() -> Column:
    """The summed amount as money with two decimals."""
    return round2(total_of(F.col("amount"), F.col("micros")))


def sound_price() -> Column:
    """A price above zero whose amount is finite and below ``MAX_AMOUNT``."""
    price = F.col("unit_price")
    amount = price * F.greatest(F.col("quantity"), F.lit(1))
    return F.coalesce((price > 0) & (amount < MAX_AMOUNT), F.lit(False))
