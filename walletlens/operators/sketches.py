"""Quantiles by mergeable sketches: one pass, a stated error, and days that are counted once.

A KLL sketch of bounded size stands for all values of a group and a day. Sketches of days merge into
sketches of months, types or the whole table without a second look at the rows, and may be stored
and refreshed by day. The value given for a fraction has a rank within ``rank_error`` of it, with a
confidence of 99 percent; a larger ``k`` makes it smaller. ``quantiles.exact_quantiles`` stays the
exact way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from walletlens import contract
from walletlens.functions import fee_rate, tx_date

# Fixed value: about 11 kB a sketch at most, and an error of 0.35 percent.
ACCURACY = 800


def rank_error(k: int = ACCURACY) -> float:
    """Half width of the interval of ranks that holds the wanted one, as published for this sketch."""
    return 2.296 / k**0.9723


def day_sketches(df: DataFrame, group: Sequence[str], value: str, k: int = ACCURACY) -> DataFrame:
    """The group, tx_date, n and a sketch of the values of each group and UTC day.

    Rows without a value are left out; a null group and a day without a readable time are groups.
    """
    rows = df.filter(F.col(value).isNotNull()).select(
        *group, tx_date(F.col("timestamp")).alias("tx_date"), F.col(value).cast("double").alias("v")
    )
    return rows.groupBy(*group, "tx_date").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch")
    )


def merged(sketches: DataFrame, group: Sequence[str], k: int = ACCURACY) -> DataFrame:
    """One sketch for each group, from sketches of any parts of it."""
    return sketches.groupBy(*group).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def quantiles_of(sketches: DataFrame, group: Sequence[str], wanted: dict[str, float], k: int = ACCURACY) -> DataFrame:
    """The group, n, and one column for each fraction: a value that the group has, with a rank near it."""
    whole = merged(sketches, group, k)
    return whole.select(
        *group, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(part)).alias(name) for name, part in wanted.items()]
    )


def sketched_type_medians(sketches: DataFrame, k: int = ACCURACY) -> DataFrame:
    """transaction_type and median_amount of the declared types, for ``detectors.high_amount``."""
    declared = sketches.filter(F.col("transaction_type").isin(*contract.TRANSACTION_TYPES))
    return quantiles_of(declared, ["transaction_type"], {"median_amount": 0.5}, k).drop("n")


def sketched_fee_rates(tx: DataFrame, k: int = ACCURACY) -> DataFrame:
    """Least, median and greatest fee rate of each type, in one pass; the ends are exact."""
    rates = tx.withColumn("rate", fee_rate(F.col("fees"), F.col("amount")))
    sketches = day_sketches(rates, ["transaction_type"], "rate", k)
    return quantiles_of(sketches, ["transaction_type"], {"min_rate": 0.0, "median_rate": 0.5, "max_rate": 1.0}, k)
