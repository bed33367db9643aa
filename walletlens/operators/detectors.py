"""Detectors for amounts, split payments, bursts, outages, places and savings circles.

Every threshold is a parameter; the defaults come from the definition of the behaviour.
A time limit is in whole seconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from walletlens import contract
from walletlens.functions import half_even
from walletlens.operators.behaviour import _most_frequent, with_range
from walletlens.operators.quantiles import exact_quantiles
from walletlens.operators.rolling import (
    dense_rows,
    frame_seconds,
    per_second,
    rolling,
    rolling_distinct,
    with_second,
)
from walletlens.sources.work import settle


class Structuring(NamedTuple):
    """One payment split into several of nearly the same amount."""

    key: tuple[str, ...] = ("sender_id", "receiver_id")
    seconds: int = 105 * 60
    least_rows: int = 4
    # Each part is the same amount give or take this part of it; a cent is for rounding.
    variation: str = "0.05"
    least_total: str = "95000"


class HighFrequency(NamedTuple):
    """Many small payments in a short time."""

    key: tuple[str, ...] = ("sender_id",)
    seconds: int = 3480
    least_rows: int = 10
    least_amount: str = "100"
    greatest_amount: str = "5000"
    types: tuple[str, ...] = ("TRANSFER", "AIRTIME", "MERCHANT")


class Tontine(NamedTuple):
    """A savings circle: many accounts pay the same amount to one account."""

    seconds: int = 2 * 3600
    least_members: int = 10
    # The payments of a circle are of one UTC day.
    same_day: bool = True

    @property
    def key(self) -> tuple[str, ...]:
        return (*_TONTINE_KEY, "day") if self.same_day else _TONTINE_KEY


class Outage(NamedTuple):
    """An operator whose payments fail in a tumbling window."""

    seconds: int = 3600
    least_rate: float = 30.0
    least_rows: int = 1


HIGH_AMOUNT_FACTOR = 10
_TONTINE_KEY = ("receiver_id", "amount")


def _amount(text: str) -> Column:
    return F.lit(text).cast("decimal(18,2)")


def _moment(second: str) -> Column:
    return F.timestamp_seconds(F.col(second))


# ---------------------------------------------------------------- amounts


def type_medians(tx: DataFrame) -> DataFrame:
    """Exact median amount of each declared type: at most as many rows as there are types."""
    declared = tx.filter(F.col("transaction_type").isin(*contract.TRANSACTION_TYPES))
    return exact_quantiles(
        declared.select("transaction_type", "amount"), ["transaction_type"], "amount", {"median_amount": 0.5}
    )


def with_amount_flags(
    tx: DataFrame, factor: float = HIGH_AMOUNT_FACTOR, medians: DataFrame | None = None
) -> DataFrame:
    """Add range_key, low, high, median_amount, above_range and above_median.

    ``medians`` has a row per type, from stored sketches for instance; without it they are exact.
    """
    medians = F.broadcast(type_medians(tx) if medians is None else medians)
    rows = with_range(tx).join(medians, "transaction_type", "left")
    return rows.withColumns(
        {
            "above_range": F.coalesce(F.col("amount") > F.col("high"), F.lit(False)),
            "above_median": F.coalesce(
                F.col("amount").cast("double") >= F.col("median_amount") * F.lit(float(factor)), F.lit(False)
            ),
        }
    )


def high_amount(tx: DataFrame, factor: float = HIGH_AMOUNT_FACTOR, medians: DataFrame | None = None) -> DataFrame:
    """Rows above the usual range of their type, or at ``factor`` times its median or more.

    A large multiple of a small payment stays inside the usual range and cannot be seen
    from its amount.
    """
    columns = ["transaction_id", "transaction_type", "bill_provider", "origin_country", "amount"]
    flagged = with_amount_flags(tx.select(*columns), factor, medians).filter("above_range OR above_median")
    return flagged.select(
        "transaction_id",
        "transaction_type",
        "amount",
        "high",
        F.round("median_amount", 4).alias("median_amount"),
        "above_range",
        "above_median",
    )


# ---------------------------------------------------------------- split payments and bursts


def successful_transfers() -> Column:
    """Rows that can be part of a split payment."""
    return (F.col("transaction_type") == "TRANSFER") & (F.col("status") == "SUCCESS")


def _structuring_alerts(rows: DataFrame, limits: Structuring) -> DataFrame:
    frames = rolling(per_second(rows, limits.key), limits.key, limits.seconds)
    variation = F.lit(limits.variation).cast("decimal(4,3)")
    near = F.col("frame_high") * (1 - variation) <= F.col("frame_low") * (1 + variation) + _amount("0.01")
    return frames.filter(
        (F.col("frame_n") >= limits.least_rows) & near & (F.col("frame_total") >= _amount(limits.least_total))
    )


def _structuring_input(tx: DataFrame, limits: Structuring) -> DataFrame:
    rows = with_second(tx.filter(successful_transfers()))
    columns = dict.fromkeys(["transaction_id", "timestamp", "sender_id", "receiver_id", "amount", "sec", *limits.key])
    return settle(dense_rows(rows.select(*columns), limits.key, limits.seconds, limits.least_rows), "dense-split")


def structuring(tx: DataFrame, limits: Structuring = Structuring()) -> DataFrame:
    """Successful transfers whose look-back frame holds a split payment."""
    rows = _structuring_input(tx, limits)
    alerts = _structuring_alerts(rows, limits)
    return rows.join(alerts, [*limits.key, "sec"]).select(
        "transaction_id",
        "timestamp",
        "sender_id",
        "receiver_id",
        "amount",
        _moment("first_sec").alias("first_time"),
        _moment("sec").alias("last_time"),
        F.col("frame_n").alias("n"),
        F.col("frame_total").alias("total"),
    )


def structuring_seconds(tx: DataFrame, limits: Structuring = Structuring()) -> DataFrame:
    """Key and second of every payment of every split payment, first ones included."""
    rows = _structuring_input(tx, limits)
    return frame_seconds(rows, _structuring_alerts(rows, limits), limits.key, limits.seconds)


def high_frequency_rows(limits: HighFrequency = HighFrequency()) -> Column:
    """Rows that can be part of a burst."""
    return (
        F.col("transaction_type").isin(*limits.types)
        & (F.col("status") == "SUCCESS")
        & F.col("amount").between(_amount(limits.least_amount), _amount(limits.greatest_amount))
    )


def _burst_input(tx: DataFrame, limits: HighFrequency) -> DataFrame:
    rows = with_second(tx.filter(high_frequency_rows(limits)))
    columns = dict.fromkeys(
        ["transaction_id", "timestamp", "sender_id", "receiver_id", "amount", "transaction_type", "status", "sec", *limits.key]
    )
    return settle(dense_rows(rows.select(*columns), limits.key, limits.seconds, limits.least_rows), "dense-burst")


def _burst_alerts(rows: DataFrame, limits: HighFrequency) -> DataFrame:
    frames = rolling(per_second(rows, limits.key), limits.key, limits.seconds)
    return frames.filter(F.col("frame_n") >= limits.least_rows)


def high_frequency(tx: DataFrame, limits: HighFrequency = HighFrequency()) -> DataFrame:
    """Rows whose look-back frame holds a burst.

    ``gap_seconds`` is the time since the key's nearest earlier second in the frame.
    """
    rows = _burst_input(tx, limits)
    alerts = _burst_alerts(rows, limits)
    return rows.join(alerts, [*limits.key, "sec"]).select(
        "transaction_id",
        "timestamp",
        "sender_id",
        "receiver_id",
        "amount",
        "transaction_type",
        _moment("first_sec").alias("first_time"),
        F.col("frame_n").alias("n"),
        (F.col("sec") - F.col("previous_sec")).alias("gap_seconds"),
    )


def high_frequency_seconds(tx: DataFrame, limits: HighFrequency = HighFrequency()) -> DataFrame:
    """Key and second of every payment of every burst, first ones included."""
    rows = _burst_input(tx, limits)
    return frame_seconds(rows, _burst_alerts(rows, limits), limits.key, limits.seconds)


# ---------------------------------------------------------------- outages


def operator_outage(tx: DataFrame, limits: Outage = Outage()) -> DataFrame:
    """Rows, failures and failure rate per operator and window, flagged above a rate."""
    failed = F.col("status") == "FAILED"
    counted = (
        tx.filter(F.col("timestamp").isNotNull())
        .groupBy("operator", F.window("timestamp", f"{limits.seconds} seconds").getField("start").alias("window_start"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(failed).alias("failed"),
            F.count_if(failed & (F.col("fees") == 0)).alias("failed_without_fees"),
        )
    )
    rate = half_even(F.col("failed") / F.col("n") * 100, 2)
    return counted.withColumn("failure_rate", rate).withColumn(
        "outage", (F.col("failure_rate") >= limits.least_rate) & (F.col("n") >= limits.least_rows)
    )


# ---------------------------------------------------------------- places


def home_regions(tx: DataFrame) -> DataFrame:
    """Most frequent receiving region per receiver, first by name of equally frequent ones."""
    counts = tx.filter(F.col("receiver_wilaya").isNotNull()).groupBy("receiver_id", "receiver_wilaya").agg(
        F.count(F.lit(1)).alias("n")
    )
    return _most_frequent(counts, "receiver_id", "receiver_wilaya").select(
        "receiver_id", F.col("receiver_wilaya").alias("home_region")
    )


def with_home_region(tx: DataFrame) -> DataFrame:
    """Add the receiver's home region.

    The table of homes has one row per account and is written first: Spark broadcasts it
    while it is small, and else joins by shuffle, where a busy receiver is split.
    """
    return tx.join(settle(home_regions(tx), "homes"), "receiver_id", "left")


def unusual_location(
    tx: DataFrame, regions: Sequence[str] | None = None, only_between_regions: bool = False
) -> DataFrame:
    """Rows received outside the receiver's home region.

    ``regions`` keeps only rows received in these regions, ``only_between_regions`` only
    rows that cross a region border.
    """
    columns = ["transaction_id", "sender_id", "receiver_id", "sender_wilaya", "receiver_wilaya"]
    rows = with_home_region(tx.select(*columns))
    rows = rows.filter(F.col("receiver_wilaya") != F.col("home_region"))
    if regions is not None:
        rows = rows.filter(F.col("receiver_wilaya").isin(*regions))
    if only_between_regions:
        rows = rows.filter(F.col("receiver_wilaya") != F.col("sender_wilaya"))
    return rows.select(*columns, "home_region")


# ---------------------------------------------------------------- savings circles


def transfers() -> Column:
    """Rows that can be part of a savings circle; a failed payment still names its payer."""
    return F.col("transaction_type") == "TRANSFER"


def _tontine_input(tx: DataFrame, limits: Tontine) -> DataFrame:
    day = [F.to_date("timestamp").alias("day")] if limits.same_day else []
    rows = with_second(tx.filter(transfers())).select(
        "transaction_id", "timestamp", "sender_id", "receiver_id", "amount", "sec", *day
    )
    return settle(dense_rows(rows, limits.key, limits.seconds, limits.least_members), "dense-circle")


def _tontine_alerts(rows: DataFrame, limits: Tontine) -> DataFrame:
    members = rolling_distinct(rows, limits.key, "sender_id", limits.seconds)
    return members.filter(F.col("members") >= limits.least_members)


def tontine(tx: DataFrame, limits: Tontine = Tontine()) -> DataFrame:
    """Transfers at which a circle of enough distinct payers is complete."""
    rows = _tontine_input(tx, limits)
    return rows.join(_tontine_alerts(rows, limits), [*limits.key, "sec"]).select(
        "transaction_id", "timestamp", "sender_id", "receiver_id", "amount", "members"
    )


def tontine_seconds(tx: DataFrame, limits: Tontine = Tontine()) -> DataFrame:
    """Receiver, amount and second of every payment of every circle, first ones included."""
    rows = _tontine_input(tx, limits)
    return frame_seconds(rows, _tontine_alerts(rows, limits), limits.key, limits.seconds).select(*_TONTINE_KEY, "sec")


def without_tontines(alerts: DataFrame, tx: DataFrame, limits: Tontine = Tontine()) -> DataFrame:
    """Alert rows that are no payment of a savings circle, which is normal behaviour.

    ``alerts`` has timestamp, receiver_id and amount, and transaction_type where it holds
    more than transfers. Circles are looked for only where an alert has their receiver and amount.
    """
    alerts = settle(alerts, "alerts")
    wanted = alerts.select(*_TONTINE_KEY).distinct()
    circles = settle(tontine_seconds(tx.join(wanted, list(_TONTINE_KEY), "left_semi"), limits), "circles")
    rows = alerts.withColumn("sec", F.unix_seconds("timestamp"))
    keys = [*_TONTINE_KEY, "sec"]
    if "transaction_type" in alerts.columns:
        circles = circles.withColumn("transaction_type", F.lit("TRANSFER"))
        keys.append("transaction_type")
    return rows.join(circles, keys, "left_anti").select(*alerts.columns)


def rows_of_alerted(tx: DataFrame, alerts: DataFrame, key: str = "sender_id") -> DataFrame:
    """All transactions of the accounts that an alert names."""
    return tx.join(settle(alerts.select(key).distinct(), "alerted"), key, "left_semi")
