"""Reads an application event log as transactions.

An event has an id, a time, a user, a kind and a value. The mapping is a plain projection,
so column pruning and filters reach the scan of the events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from walletlens import contract
from walletlens.functions import Season, in_season

# The season of the mapped log: the events lie in January 2024.
LOG_SEASONS = (Season("2024-01-11", "2024-01-20"),)
LOG_FIRST_DAY = "2024-01-01"
LOG_LAST_DAY = "2024-01-30"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (index + 1).cast("int"))


def _mapped(events: DataFrame) -> DataFrame:
    """The 18 columns and the id of the event."""
    i = F.col("event_id")
    u = F.col("user_id")
    kind = F.col("event_type")
    value = F.col("value").cast("decimal(18,2)")
    other = F.when(i % 7 == 3, 140 + i % 5).otherwise((u * 7 + i % 11 + 1) % 150)

    def account(number: Column) -> Column:
        digits = number.cast("string")
        return F.concat(F.lit("ACC_"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))

    amount = (
        F.when(i % 977 == 0, F.lit(600000).cast("decimal(18,2)"))
        .when(i % 7 == 3, F.lit(500).cast("decimal(18,2)"))
        .when(i % 97 == 0, (value * 2000).cast("decimal(18,2)"))
        .otherwise((value * 100).cast("decimal(18,2)"))
    )
    mapped = events.select(
        i.alias("event_id"),
        F.concat(F.lit("EVT_"), F.when(i % 400 == 399, i - 1).otherwise(i).cast("string")).alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        account(u).alias("sender_id"),
        account(other).alias("receiver_id"),
        amount.alias("amount"),
        F.when(i % 501 == 0, "EUR").when(i % 25 == 0, "XOF").when(i % 25 == 1, "USD").otherwise("MRU").alias("currency"),
        F.when(i % 10 == 0, "AIRTIME")
        .when(kind == "purchase", "MERCHANT")
        .when(kind == "click", "TRANSFER")
        .when(kind == "view", "BILL_PAY")
        .when(kind == "signup", "CASH_IN")
        .when(kind == "error", "CASH_OUT")
        .alias("transaction_type"),
        F.when(i % 701 == 0, F.lit(None).cast("string"))
        .when(i % 20 < 14, "USSD")
        .when(i % 20 < 19, "APP")
        .otherwise("AGENT")
        .alias("channel"),
        _pick(contract.OPERATORS, u % 9).alias("operator"),
        _pick(contract.REGIONS, F.when(i % 307 == 0, (u + 1) % 15).otherwise(u % 15)).alias("sender_wilaya"),
        _pick(contract.REGIONS, F.when(i % 89 == 0, (other + 7) % 15).otherwise(other % 15)).alias("receiver_wilaya"),
        F.when((kind == "error") & (i % 3 == 0), "FAILED")
        .when(i % 50 == 7, "PENDING")
        .otherwise("SUCCESS")
        .alias("status"),
        u.alias("user_id"),
    )
    free = F.col("transaction_type").isin("AIRTIME", "BILL_PAY") | (F.col("status") == "FAILED")
    outage = (F.col("status") == "FAILED") & (i % 6 == 0)
    labelled_high = (i % 97 == 0) | (i % 977 == 0)
    rows = mapped.withColumns(
        {
            "fees": F.when(i % 613 == 0, (F.col("amount") * 2).cast("decimal(18,2)"))
            .when(free, F.lit(0).cast("decimal(18,2)"))
            .otherwise((F.col("amount") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")),
            "is_ramadan": in_season(F.col("timestamp"), LOG_SEASONS),
            "bill_provider": F.when(
                (F.col("transaction_type") == "BILL_PAY") & (i % 211 != 0),
                _pick(["SOMELEC", "SNDE", "MAURITEL", "CHINGUITEL"], F.col("user_id") % 4),
            ),
            "origin_country": F.when(
                (F.col("transaction_type") == "CASH_IN") & (i % 5 == 1),
                _pick(["ES", "US", "FR", "FR"], F.col("user_id") % 4),
            ),
            "is_anomaly": labelled_high | outage | (i % 499 == 0),
            "anomaly_type": F.when(labelled_high, "HIGH_AMOUNT").when(outage, "OPERATOR_OUTAGE").otherwise("NONE"),
        }
    )
    return rows.select(*contract.COLUMNS, "event_id")


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Typed transactions, the 18 columns in order."""
    return _mapped(events).select(*contract.COLUMNS)


def raw_text_from_events(events: DataFrame) -> DataFrame:
    """The same rows as a text source would give them, with one defect in some of them.

    The place of a row in a cycle of 251 decides its defect.
    """
    place = (F.col("event_id") % 251).cast("int")
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def cell(column: str, *cases: tuple[int, str | None]) -> Column:
        result = F.col(column).cast("string")
        for at, bad in reversed(cases):
            result = F.when(F.col("place") == at, F.lit(bad).cast("string")).otherwise(result)
        return result.alias(column)

    offset = (
        F.when(F.col("place") == 1, "")
        .when(F.col("place") == 2, "+01:00")
        .when(F.col("place") > 125, "Z")
        .otherwise("+00:00")
    )
    stamp = F.when(F.col("place") == 3, "not a date").when(F.col("place") == 4, "").otherwise(F.concat(text, offset))
    # Observed rows are counted for the query listener, and the two projections are compiled
    # as two methods; in one they outgrow what the JVM compiles.
    mapped = _mapped(events).observe(f"mapped-events-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    return mapped.withColumn("place", place).select(
        cell("transaction_id", (5, "  ")),
        stamp.alias("timestamp"),
        cell("sender_id", (6, "ACC_0001"), (7, "ACC_00001\n"), (26, "  ACC_00001 ")),
        cell("receiver_id", (8, None)),
        cell("amount", (9, "abc"), (10, "-5.00"), (11, "1.005")),
        cell("currency"),
        cell("transaction_type", (12, "GIFT")),
        cell("channel", (13, "WEB")),
        cell("operator", (14, "Nope")),
        cell("sender_wilaya", (15, " ")),
        cell("receiver_wilaya", (16, "Atlantis")),
        cell("status", (17, "DONE")),
        cell("fees", (18, "-1"), (19, "0.001"), (20, "")),
        cell("is_ramadan", (21, "maybe")),
        cell("bill_provider", (22, "ACME")),
        cell("origin_country", (23, "fr")),
        cell("is_anomaly", (24, "perhaps")),
        cell("anomaly_type", (25, "ODD")),
    )


def load_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of the ``events`` table in ``folder``."""
    return transactions_from_events(spark.read.parquet(f"{folder.rstrip('/')}/events.parquet"))


def load_raw_text(spark: SparkSession, folder: str) -> DataFrame:
    return raw_text_from_events(spark.read.parquet(f"{folder.rstrip('/')}/events.parquet"))
