"""Expected mixes, amount ranges and calendars as small tables.

The tables made here have a fixed number of rows, so they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from walletlens.functions import DEFAULT_SEASONS, Season, salary_weight, season_weight

# The expected shares, in percent of a mix.

EXPECTED_MIXES = {
    "operator": {
        "Bankily": 30.0,
        "Masrvi": 18.0,
        "Sedad": 15.0,
        "Click": 10.0,
        "bimbank Mobile": 8.0,
        "Bamis Digital": 6.0,
        "GazaPay": 5.0,
        "BaridCash": 4.0,
        "BCIpay": 4.0,
    },
    "sender_wilaya": {
        "Nouakchott-Ouest": 20.0,
        "Nouakchott-Nord": 20.0,
        "Nouakchott-Sud": 20.0,
        "Dakhlet Nouadhibou": 15.0,
        "Trarza": 5.0,
        "Brakna": 4.0,
        "Gorgol": 3.0,
        "Hodh El Chargui": 3.0,
        "Assaba": 3.0,
        "Guidimakha": 2.0,
        "Hodh El Gharbi": 1.5,
        "Adrar": 1.5,
        "Tagant": 1.0,
        "Tiris Zemmour": 1.0,
        "Inchiri": 1.0,
    },
    "channel_urban": {"USSD": 70.0, "APP": 25.0, "AGENT": 5.0},
    "channel_rural": {"USSD": 85.0, "APP": 10.0, "AGENT": 5.0},
    "type_salary_days": {
        "CASH_OUT": 40.0,
        "BILL_PAY": 30.0,
        "TRANSFER": 20.0,
        "MERCHANT": 5.0,
        "AIRTIME": 3.0,
        "CASH_IN": 2.0,
    },
    "type_other_days": {
        "TRANSFER": 35.0,
        "BILL_PAY": 12.0,
        "MERCHANT": 18.0,
        "CASH_IN": 12.0,
        "CASH_OUT": 13.0,
        "AIRTIME": 10.0,
    },
    "bill_provider": {"SOMELEC": 45.0, "SNDE": 30.0, "MAURITEL": 15.0, "CHINGUITEL": 10.0},
    "origin_country": {"FR": 50.0, "ES": 25.0, "US": 25.0},
}

# Least and greatest usual amount. A provider or the diaspora overrides its type.

AMOUNT_RANGES = {
    "TRANSFER": ("100.00", "80000.00"),
    "BILL_PAY": ("400.00", "8000.00"),
    "MERCHANT": ("100.00", "25000.00"),
    "CASH_IN": ("500.00", "85000.00"),
    "CASH_OUT": ("500.00", "90000.00"),
    "AIRTIME": ("50.00", "2000.00"),
    "BILL_PAY/SOMELEC": ("800.00", "8000.00"),
    "BILL_PAY/SNDE": ("400.00", "2000.00"),
    "BILL_PAY/MAURITEL": ("200.00", "3000.00"),
    "BILL_PAY/CHINGUITEL": ("200.00", "3000.00"),
    "CASH_IN/DIASPORA": ("5000.00", "80000.00"),
}

# Expected part of cash-in from abroad, in percent, and its weekend factor.

DIASPORA_SHARE = 20.0
DIASPORA_WEEKEND_FACTOR = 1.4


def _values(spark: SparkSession, rows: Sequence[Sequence[object]], columns: str) -> DataFrame:
    """A literal table; its size is part of the plan, so Spark can see that it is small."""
    def literal(value: object) -> str:
        return repr(value) if isinstance(value, float) else "'" + str(value).replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(value) for value in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def expected_mixes(
    spark: SparkSession, mixes: Mapping[str, Mapping[str, float]] = EXPECTED_MIXES
) -> DataFrame:
    """Rows of (mix, value, expected_share)."""
    rows = [(mix, value, float(share)) for mix, shares in mixes.items() for value, share in shares.items()]
    return _values(spark, rows, "mix, value, expected_share").select(
        "mix", "value", F.col("expected_share").cast("double").alias("expected_share")
    )


def amount_ranges(
    spark: SparkSession, ranges: Mapping[str, tuple[str, str]] = AMOUNT_RANGES
) -> DataFrame:
    """Rows of (range_key, low, high)."""
    rows = [(key, low, high) for key, (low, high) in ranges.items()]
    money = [F.col(name).cast("decimal(18,2)").alias(name) for name in ("low", "high")]
    return _values(spark, rows, "range_key, low, high").select("range_key", *money)


def calendar(
    spark: SparkSession, first: str, last: str, seasons: Sequence[Season] = DEFAULT_SEASONS
) -> DataFrame:
    """One row per day with its weight: season weight times salary weight, as an exact decimal."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("tx_date")
    )
    weight = season_weight(F.col("tx_date"), seasons) * salary_weight(F.col("tx_date"))
    return days.withColumn("weight", weight.cast("decimal(6,2)"))
