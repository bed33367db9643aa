"""Rolling measures per key over a span of seconds, for keys of any size.

Spark's own sliding frame puts a whole key into one task and adds up every frame anew.
Here time is cut into blocks as long as the frame. A frame then reaches over at most two
blocks, so each row goes to its own block and, as a visitor, to the next one. Inside a
block a running total of the own rows, plus a running total from the other end of the
visitors, gives the frame. A key is thereby split over as many tasks as it has blocks, the
work grows with the rows and not with the rows per frame, and the result is exact.

Rows of one key and second are combined before the shuffle, so a block holds at most two
frames' worth of seconds, whatever the number of rows.

Times are whole seconds: a frame of ``seconds`` reaches from ``sec - seconds`` to ``sec``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from walletlens.sources.work import settle


def with_second(tx: DataFrame) -> DataFrame:
    return tx.withColumn("sec", F.unix_seconds("timestamp"))


def in_blocks(rows: DataFrame, seconds: int, at: Column | None = None) -> DataFrame:
    """Each row twice: in its own block, and as ``visitor`` in the next one."""
    at = F.col("sec") if at is None else at
    return rows.withColumn("visitor", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "block", F.floor(at / (seconds + 1)) + F.col("visitor").cast("int")
    )


def dense_rows(rows: DataFrame, keys: Sequence[str], seconds: int, least: int) -> DataFrame:
    """Rows that can lie in a frame with ``least`` or more rows of their key; drops no other.

    A frame lies in one block and its visitors. Blocks are counted first; few have enough
    rows, and everything after works on those alone. The list of dense blocks is written,
    so Spark knows its size and broadcasts it only when it is small.
    """
    own = F.floor(F.col("sec") / (seconds + 1))
    counted = (
        rows.groupBy(*keys, own.alias("own"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("block", F.explode(F.array(F.col("own"), F.col("own") + 1)))
        .groupBy(*keys, "block")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
    )
    # A row counts for its own block and the next one; one of them has to be dense.
    dense = settle(
        counted.select(*keys, F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("own")).distinct(),
        "dense-blocks",
    )
    return rows.withColumn("own", own).join(dense, [*keys, "own"], "left_semi").drop("own")


def per_second(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and second: rows, amount, least and greatest amount."""
    return rows.groupBy(*keys, "sec").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("total"),
        F.min("amount").alias("low"),
        F.max("amount").alias("high"),
    )


def rolling(seconds_table: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Measures of the frame that ends at each second of ``per_second``.

    Adds frame_n, frame_total, frame_low, frame_high, first_sec and previous_sec, the
    nearest earlier second of the key inside the frame.
    """
    span = seconds + 1
    rows = in_blocks(seconds_table, seconds)
    # A visitor stays in sight until the frame has moved past it.
    rows = rows.withColumn(
        "mark", F.when(F.col("visitor"), F.col("sec") + (span - 1)).otherwise(F.col("sec"))
    )
    part = [*keys, "block"]
    to_here = Window.partitionBy(*part).orderBy("mark").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy("mark").rangeBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy(*part).orderBy(F.desc("mark")).rangeBetween(Window.unboundedPreceding, 0)

    def own(name: str) -> Column:
        return F.when(~F.col("visitor"), F.col(name))

    def guest(name: str) -> Column:
        return F.when(F.col("visitor"), F.col(name))

    seen = (
        rows.withColumns(
            {
                "own_n": F.sum(own("n")).over(to_here),
                "own_total": F.sum(own("total")).over(to_here),
                "own_low": F.min(own("low")).over(to_here),
                "own_high": F.max(own("high")).over(to_here),
                "own_first": F.min(own("sec")).over(to_here),
                "own_previous": F.max(own("sec")).over(before),
            }
        )
        .withColumns(
            {
                "guest_n": F.sum(guest("n")).over(from_here),
                "guest_total": F.sum(guest("total")).over(from_here),
                "guest_low": F.min(guest("low")).over(from_here),
                "guest_high": F.max(guest("high")).over(from_here),
                "guest_first": F.min(guest("sec")).over(from_here),
                "guest_last": F.max(guest("sec")).over(from_here),
            }
        )
        .filter(~F.col("visitor"))
    )
    return seen.select(
        *keys,
        "sec",
        (F.col("own_n") + F.coalesce("guest_n", F.lit(0))).alias("frame_n"),
        (F.col("own_total") + F.coalesce("guest_total", F.lit(0))).cast("decimal(38,2)").alias("frame_total"),
        F.least("own_low", "guest_low").alias("frame_low"),
        F.greatest("own_high", "guest_high").alias("frame_high"),
        F.coalesce("guest_first", "own_first").alias("first_sec"),
        F.coalesce("own_previous", "guest_last").alias("previous_sec"),
    )


def rolling_distinct(
    rows: DataFrame, keys: Sequence[str], member: str, seconds: int
) -> DataFrame:
    """Distinct ``member`` values of a key in the frame that ends at each second; exact.

    A member counts from its payment until it leaves the frame or pays again. These
    stretches do not overlap for one member, so the number of open stretches is the number
    of distinct members, and a running total of starts and ends gives it. No set of
    members is ever held in memory.
    """
    span = seconds + 1
    paid = in_blocks(rows.select(*keys, member, "sec").distinct(), seconds)
    own_payments = Window.partitionBy(*keys, member, "block").orderBy("sec")
    stretches = paid.select(
        *keys,
        "block",
        F.greatest(F.col("sec"), F.col("block") * span).alias("opens"),
        F.least(
            F.lead("sec").over(own_payments), F.col("sec") + span, (F.col("block") + 1) * span
        ).alias("closes"),
    ).filter("opens < closes")
    steps = (
        stretches.select(
            *keys,
            "block",
            F.inline(
                F.array(
                    F.struct(F.col("opens").alias("sec"), F.lit(1).alias("step")),
                    F.struct(F.col("closes").alias("sec"), F.lit(-1).alias("step")),
                )
            ),
        )
        .groupBy(*keys, "block", "sec")
        .agg(F.sum("step").alias("step"))
    )
    running = Window.partitionBy(*keys, "block").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("members", F.sum("step").over(running))
    # The last close of a block falls on the first second of the next one.
    return counted.filter(F.col("sec") < (F.col("block") + 1) * span).select(*keys, "sec", "members")


def frame_seconds(seconds_of_rows: DataFrame, alerts: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Seconds of rows that lie in the frame of at least one alert.

    Equals: the next alert of the key, at or after the row, is at most ``seconds`` away.
    Alerts visit the block before their own, so no row is paired with all alerts.
    """
    rows = seconds_of_rows.select(*keys, "sec", F.lit(False).alias("alert")).distinct()
    marks = alerts.select(*keys, "sec", F.lit(True).alias("alert")).distinct()
    span = seconds + 1
    own = F.floor(F.col("sec") / span)
    placed = rows.withColumn("block", own).unionByName(
        marks.withColumn("block", F.explode(F.array(own, own - 1)))
    )
    later = Window.partitionBy(*keys, "block").orderBy(F.desc("sec")).rangeBetween(Window.unboundedPreceding, 0)
    near = placed.withColumn("next_alert", F.min(F.when(F.col("alert"), F.col("sec"))).over(later))
    return near.filter(~F.col("alert") & (F.col("next_alert") - F.col("sec") <= seconds)).select(*keys, "sec")
