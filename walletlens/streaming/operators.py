"""Event-time operators on streams of transactions.

Each takes a streaming table and returns one; the caller chooses sink and trigger. Rows
older than the watermark drop out of the windowed operators and still pass the row check.
A file that is not in time order has to be sorted or partitioned by date before it is
replayed as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from walletlens.functions import half_even
from walletlens.operators.detectors import (
    HighFrequency,
    Outage,
    Tontine,
    high_frequency_rows,
    transfers,
)
from walletlens.operators.validation import with_route

# Fixed value: the span of a savings circle, the longest behaviour that is watched.
LATENESS = "2 hours"

# Fixed value: 4096 registers, a relative standard error of 1.6 percent. Up to 383 payers a sketch keeps their hashes.
PAYER_REGISTERS = 12


def stream_validate(tx: DataFrame) -> DataFrame:
    """Stateless row check with a route per row."""
    return with_route(tx)


def stream_dedup(tx: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row of each id, any of a micro-batch; an id is remembered until the watermark has passed it."""
    return tx.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["transaction_id"])


def _windowed(tx: DataFrame, lateness: str) -> DataFrame:
    return tx.withWatermark("timestamp", lateness)


def _bounds(frame: str = "frame") -> list[Column]:
    return [F.col(f"{frame}.start").alias("window_start"), F.col(f"{frame}.end").alias("window_end")]


def stream_volume(tx: DataFrame, length: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Rows per tumbling window."""
    counted = _windowed(tx, lateness).groupBy(F.window("timestamp", length).alias("frame")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(*_bounds(), "n")


def stream_outage(tx: DataFrame, limits: Outage = Outage(), lateness: str = LATENESS) -> DataFrame:
    """Rows, failures and failure rate per operator and tumbling window."""
    failed = F.col("status") == "FAILED"
    counted = _windowed(tx, lateness).groupBy("operator", F.window("timestamp", f"{limits.seconds} seconds").alias("frame")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("fees") == 0)).alias("failed_without_fees"),
    )
    rate = half_even(F.col("failed") / F.col("n") * 100, 2)
    return counted.select(
        "operator",
        *_bounds(),
        "n",
        "failed",
        "failed_without_fees",
        rate.alias("failure_rate"),
        ((rate >= limits.least_rate) & (F.col("n") >= limits.least_rows)).alias("outage"),
    )


def stream_burst(
    tx: DataFrame,
    limits: HighFrequency = HighFrequency(),
    length: str = "70 minutes",
    slide: str = "10 minutes",
    lateness: str = LATENESS,
) -> DataFrame:
    """Windows of a sender with enough small payments.

    The window is longer than a burst by one slide, so each burst lies whole in some
    window. The result holds all bursts of the batch detector and may hold more.
    """
    rows = _windowed(tx.filter(high_frequency_rows(limits)), lateness)
    counted = rows.groupBy(*limits.key, F.window("timestamp", length, slide).alias("frame")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total")
    )
    return counted.filter(F.col("n") >= limits.least_rows).select(*limits.key, *_bounds(), "n", "total")


def stream_tontine(
    tx: DataFrame,
    limits: Tontine = Tontine(),
    length: str = "130 minutes",
    slide: str = "10 minutes",
    lateness: str = LATENESS,
) -> DataFrame:
    """Windows in which enough distinct accounts pay one amount to one account.

    Payers are counted exactly: the first aggregate keeps one row per payer and window,
    the second one counts them when the window has closed. Append mode.
    """
    rows = _windowed(
        tx.filter(transfers()), lateness
    )
    payers = rows.groupBy(
        F.window("timestamp", length, slide).alias("frame"), "receiver_id", "amount", "sender_id"
    ).agg(F.count(F.lit(1)).alias("payments"))
    circles = payers.groupBy("frame", "receiver_id", "amount").agg(
        F.count(F.lit(1)).alias("members"), F.sum("payments").alias("payments")
    )
    return circles.filter(F.col("members") >= limits.least_members).select(
        "receiver_id", "amount", *_bounds(), "members", "payments"
    )


def stream_tontine_estimate(
    tx: DataFrame,
    limits: Tontine = Tontine(),
    length: str = "130 minutes",
    slide: str = "10 minutes",
    lateness: str = LATENESS,
) -> DataFrame:
    """As ``stream_tontine`` with an estimated number of payers, available before a window closes.

    Most windows have few payers. Their sketches are small and grow with the payers; those of
    ``approx_count_distinct`` are of full size, 3.3 kB, from the first payer on. An empty name is a payer, too.
    """
    rows = _windowed(
        tx.filter(transfers()), lateness
    )
    payer = F.when(F.col("sender_id").isNotNull(), F.xxhash64("sender_id"))
    circles = rows.groupBy(F.window("timestamp", length, slide).alias("frame"), "receiver_id", "amount").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(payer, PAYER_REGISTERS)).alias("members")
    )
    return circles.filter(F.col("members") >= limits.least_members).select(
        "receiver_id", "amount", *_bounds(), "members"
    )


def stream_sessions(tx: DataFrame, gap: str = "10 minutes", lateness: str = LATENESS) -> DataFrame:
    """Stretches of activity per sender, closed by a gap. Append mode."""
    sessions = _windowed(tx, lateness).groupBy("sender_id", F.session_window("timestamp", gap).alias("frame")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total")
    )
    return sessions.select("sender_id", *_bounds(), "n", "total")
