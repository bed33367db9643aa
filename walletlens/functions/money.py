"""Amounts, shares and ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(value: Column) -> Column:
    """Two decimals, halves rounded up; 18 places are seen before the only rounding."""
    return F.round(value.cast("decimal(38,18)"), 2).cast("decimal(18,2)")


def half_even(value: Column, digits: int = 2) -> Column:
    """Rounds the scaled double, halves to even, as numeric Python libraries do."""
    scale = F.lit(float(10**digits))
    return F.rint(value.cast("double") * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, two decimals, halves to even; 0 for an empty whole."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(half_even(share, 2), F.lit(0.0))


def guarded_ratio(value: Column, divisor: Column) -> Column:
    """Two-decimal quotient, 0 when the divisor is 0 or null."""
    quotient = value.cast("double") / F.nullif(divisor.cast("double"), F.lit(0.0))
    return F.coalesce(half_even(quotient, 2), F.lit(0.0))


def fee_rate(fees: Column, amount: Column) -> Column:
    """Fees as a part of the amount, null when the amount is 0."""
    return fees.cast("double") / F.nullif(amount.cast("double"), F.lit(0.0))
