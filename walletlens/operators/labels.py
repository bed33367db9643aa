"""One label per row from all detectors, and its comparison with stored labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from walletlens import contract
from walletlens.functions import half_even
from walletlens.operators import detectors as d
from walletlens.operators.rolling import with_second
from walletlens.sources.work import settle


class Limits(NamedTuple):
    structuring: d.Structuring = d.Structuring()
    high_frequency: d.HighFrequency = d.HighFrequency()
    outage: d.Outage = d.Outage()
    high_amount_factor: float = d.HIGH_AMOUNT_FACTOR


def rule_label(tx: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Transactions with ``rule_label`` and ``rule_flag``.

    Sequences come first: split payments, then bursts, each with all their payments. Then
    high amounts, failed free rows in an outage, and unusual places. What the detectors
    found is written first, so each of these joins knows the size of its small side.
    """
    split = settle(d.structuring_seconds(tx, limits.structuring), "split-payments").withColumn("split", F.lit(True))
    burst = settle(d.high_frequency_seconds(tx, limits.high_frequency), "bursts").withColumn("burst", F.lit(True))
    outages = settle(
        d.operator_outage(tx, limits.outage).filter("outage").select("operator", "window_start"), "outages"
    ).withColumn("down", F.lit(True))

    rows = with_second(d.with_home_region(d.with_amount_flags(tx, limits.high_amount_factor)))
    rows = rows.withColumn("window_start", _window_start(limits.outage.seconds))
    rows = (
        rows.join(split, [*limits.structuring.key, "sec"], "left")
        .join(burst, [*limits.high_frequency.key, "sec"], "left")
        .join(outages, ["operator", "window_start"], "left")
    )
    label = (
        F.when(F.col("split") & d.successful_transfers(), "STRUCTURING")
        .when(F.col("burst") & d.high_frequency_rows(limits.high_frequency), "HIGH_FREQUENCY")
        .when(F.col("above_range") | F.col("above_median"), "HIGH_AMOUNT")
        .when(F.col("down") & (F.col("status") == "FAILED") & (F.col("fees") == 0), "OPERATOR_OUTAGE")
        .when(F.col("receiver_wilaya") != F.col("home_region"), "UNUSUAL_LOCATION")
        .otherwise("NONE")
    )
    return rows.select(*tx.columns, label.alias("rule_label")).withColumn(
        "rule_flag", F.col("rule_label") != "NONE"
    )


def _window_start(seconds: int):
    """Start of the tumbling window of a row, without grouping."""
    return F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / seconds) * seconds)


def label_scorecard(labelled: DataFrame) -> DataFrame:
    """Hits, false alarms, misses, precision and recall per anomaly type.

    The table is reduced to its pairs of labels first; the scores come from those.
    """
    pairs = labelled.groupBy("anomaly_type", "rule_label").agg(F.count(F.lit(1)).alias("n"))
    label = F.explode(F.array(*[F.lit(name) for name in contract.ANOMALY_TYPES]))
    stored = F.coalesce(F.col("anomaly_type") == F.col("label"), F.lit(False))
    found = F.col("rule_label") == F.col("label")

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    scores = pairs.select("*", label.alias("label")).groupBy("label").agg(
        total(stored & found).alias("hits"),
        total(~stored & found).alias("false_alarms"),
        total(stored & ~found).alias("misses"),
    )

    def ratio(divisor):
        return F.coalesce(half_even(F.col("hits") / F.nullif(divisor, F.lit(0)), 4), F.lit(0.0))

    return scores.select(
        "label",
        "hits",
        "false_alarms",
        "misses",
        ratio(F.col("hits") + F.col("false_alarms")).alias("precision"),
        ratio(F.col("hits") + F.col("misses")).alias("recall"),
    )
