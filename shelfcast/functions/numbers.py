"""Rounding, exact sums and ratios as column expressions."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

_MICRO = Decimal("0.000001")


def round2(c: Column) -> Column:
    """Two decimals, halves up, by plain double arithmetic.

    From 1e15 on a double has no second decimal left, and stays as it is.
    """
    return F.when(F.abs(c) < 1e15, F.floor(c * 100 + 0.5) / F.lit(100.0)).otherwise(c.cast("double"))


def round0(c: Column) -> Column:
    """Whole number as a double, halves up."""
    return F.floor(c + 0.5).cast("double")


def truncate(c: Column) -> Column:
    """Whole number toward zero."""
    return c.cast("bigint")


def fixed_point(c: Column, decimals: int) -> Column:
    """The value as a whole count of ``10**-decimals``."""
    return F.floor(c * float(10**decimals) + 0.5)


def whole_and_micros(c: Column) -> tuple[Column, Column]:
    """The whole part of a double below 9e18, and the rest in millionths: two longs."""
    whole = F.floor(c)
    return whole, F.floor((c - whole) * 1e6 + 0.5)


def total_of(whole: Column, micros: Column) -> Column:
    """The double closest to the sum of both parts."""
    parts = whole.cast("decimal(20,0)") + micros.cast("decimal(20,0)") * F.lit(_MICRO)
    return parts.cast("double")


def exact_sum(c: Column) -> Column:
    """Sum that does not depend on row order.

    Whole parts and millionths are added as longs, so partial sums may be merged in
    any order, and hash aggregation keeps primitive slots. A total beyond 9.2e18 is
    null, not an error: one absurd value must not end a job.
    """
    whole, micros = whole_and_micros(c.cast("double"))
    return total_of(F.try_sum(whole), F.try_sum(micros))


def exact_avg(c: Column) -> Column:
    """Order-independent mean over non-null values; null when there are none."""
    return F.try_divide(exact_sum(c), F.count(c))


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; an empty whole counts as one."""
    return round2(part / F.greatest(whole, F.lit(1)) * 100)
