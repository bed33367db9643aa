"""Column functions: money, calendar and text rules of the transaction record."""

from walletlens.functions.calendar import (
    Season,
    DEFAULT_SEASONS,
    day_bound,
    day_of_month,
    in_day_range,
    in_season,
    is_diaspora_weekend,
    is_salary_day,
    month_half,
    salary_weight,
    season_weight,
    tx_date,
    utc_timestamp,
)
from walletlens.functions.money import fee_rate, guarded_ratio, half_even, money, percent
from walletlens.functions.text import (
    account_id,
    blank_to_null,
    in_capital,
    in_capital_by_prefix,
    in_port,
    is_rural,
    truthy,
)

__all__ = [
    "Season",
    "DEFAULT_SEASONS",
    "account_id",
    "blank_to_null",
    "day_bound",
    "day_of_month",
    "fee_rate",
    "guarded_ratio",
    "half_even",
    "in_capital",
    "in_capital_by_prefix",
    "in_day_range",
    "in_port",
    "in_season",
    "is_diaspora_weekend",
    "is_rural",
    "is_salary_day",
    "money",
    "month_half",
    "percent",
    "salary_weight",
    "season_weight",
    "truthy",
    "tx_date",
    "utc_timestamp",
]
