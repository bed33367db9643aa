"""Calendar rules. All dates are UTC dates: the session time zone must be UTC."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Season(NamedTuple):
    """First and last day, both inside the season, as ``YYYY-MM-DD``."""

    first: str
    last: str


# The season, its weight, and the weight and days of the salary period.
DEFAULT_SEASONS = (Season("2026-02-17", "2026-03-18"),)
SEASON_WEIGHT = 2.5
SALARY_WEIGHT = 1.8
FIRST_SALARY_DAY = 1
LAST_SALARY_DAY = 5

# An ISO 8601 date and time, with or without an offset.
TIMESTAMP_PATTERN = (
    r"^\s*\d{4}-\d{2}-\d{2}[Tt _]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?"
    r"\s*([Zz]|[+-]\d{2}(:?\d{2})?)?\s*\z"
)


def utc_timestamp(value: Column) -> Column:
    """Timestamp of an ISO 8601 text, null when it cannot be read."""
    text = F.replace(F.upper(F.trim(value.cast("string"))), F.lit(","), F.lit("."))
    return F.when(value.rlike(TIMESTAMP_PATTERN), F.try_to_timestamp(F.replace(text, F.lit("_"), F.lit(" "))))


def tx_date(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def day_of_month(timestamp: Column) -> Column:
    return F.dayofmonth(timestamp)


def in_season(timestamp: Column, seasons: Sequence[Season] = DEFAULT_SEASONS) -> Column:
    """True when the date lies in one of the seasons."""
    day = F.to_date(timestamp)
    inside = F.lit(False)
    for season in seasons:
        inside = inside | day.between(F.lit(season.first).cast("date"), F.lit(season.last).cast("date"))
    return inside


def season_weight(timestamp: Column, seasons: Sequence[Season] = DEFAULT_SEASONS) -> Column:
    return F.when(in_season(timestamp, seasons), F.lit(SEASON_WEIGHT)).otherwise(F.lit(1.0))


def is_salary_day(timestamp: Column) -> Column:
    return F.dayofmonth(timestamp).between(FIRST_SALARY_DAY, LAST_SALARY_DAY)


def salary_weight(timestamp: Column) -> Column:
    return F.when(is_salary_day(timestamp), F.lit(SALARY_WEIGHT)).otherwise(F.lit(1.0))


def is_diaspora_weekend(timestamp: Column) -> Column:
    """Friday, Saturday or Sunday."""
    return F.weekday(timestamp).isin(4, 5, 6)


def month_half(timestamp: Column) -> Column:
    return F.when(F.dayofmonth(timestamp) <= 10, F.lit("DAY_1_10")).otherwise(F.lit("DAY_11_31"))


def day_bound(day: str, end_of_day: bool = False) -> Column:
    """First or last second of a UTC day."""
    start = F.lit(day).cast("date").cast("timestamp")
    return start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") if end_of_day else start


def in_day_range(timestamp: Column, first: str, last: str) -> Column:
    """Between the first second of ``first`` and the last second of ``last``; reaches the scan."""
    return timestamp.between(day_bound(first), day_bound(last, end_of_day=True))
