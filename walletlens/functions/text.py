"""Text and region rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from walletlens import contract


def blank_to_null(value: Column) -> Column:
    """Null for text of white space only; other text is left as it is, untrimmed."""
    return F.when(~value.rlike(r"(?U)^\s*\z"), value)


def truthy(value: Column) -> Column:
    """True for the texts ``true`` and ``1`` in any case, false for all else and for null."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def in_capital(region: Column) -> Column:
    return F.coalesce(region.isin(*contract.CAPITAL_REGIONS), F.lit(False))


def in_capital_by_prefix(region: Column) -> Column:
    return F.coalesce(region.startswith(contract.CAPITAL_PREFIX), F.lit(False))


def in_port(region: Column) -> Column:
    return F.coalesce(region == contract.PORT_REGION, F.lit(False))


def is_rural(region: Column) -> Column:
    return F.coalesce(region.isin(*contract.RURAL_REGIONS), F.lit(False))


def account_id(number: Column) -> Column:
    """Account key of a whole number from 0 to 99,999; null outside, so keys never collide."""
    key = F.concat(F.lit("ACC_"), F.lpad(number.cast("string"), 5, "0"))
    return F.when(number.between(0, 99_999), key)
