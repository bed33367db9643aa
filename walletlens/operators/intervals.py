"""Rows and the dated intervals that hold them: seasons, price ranges, campaigns from tables.

A table of intervals may have any number of rows that overlap in any way. It is neither broadcast nor
crossed with the rows: an interval belongs to the level of its length, on which bins are as long as
the interval or less than twice as long, so it lies in two bins at most. A row lies in one bin of each level
in use. Rows and intervals meet by an equi-join on their keys, level and bin, and each pair once.
Levels are powers of two of days, so there are few whatever the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from walletlens.sources.work import settle

# Longest interval: 2 ** 23 days; a longer one, or an open end, is cut to it.
_LEVELS = 24
_OPEN_DAY = 5_000_000


def _day(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date"))


def within(rows: DataFrame, day: Column, intervals: DataFrame, keys: Sequence[str], first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Each row with each interval of its keys that holds its day; both ends belong to the interval.

    ``rows`` and ``intervals`` share only ``keys`` by name. An open end is null, a null key of an
    interval holds for no row, and a row without a day is in no interval. An interval that ends before it
    starts holds nothing.
    """
    start = F.coalesce(_day(first), F.lit(-_OPEN_DAY))
    end = F.coalesce(_day(last), F.lit(_OPEN_DAY))
    length = F.col("_end") - F.col("_start") + 1
    # The least level whose bins are as long as the interval.
    level = F.ceil(F.log2(length)).cast("int")
    placed = intervals.withColumn("_start", start).withColumn("_end", end).filter("_start <= _end").withColumn("_level", level)
    width = F.expr("shiftleft(1, _level)")
    placed = settle(
        placed.withColumn(
            "_bin", F.explode(F.array_distinct(F.array(F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))))
        ),
        "interval-bins",
    )
    used = [row[0] for row in placed.select("_level").distinct().toLocalIterator()]
    if not used:
        used = [0]
    at = rows.withColumn("_day", F.unix_date(day.cast("date"))).filter(F.col("_day").isNotNull())
    spread = at.withColumn("_level", F.explode(F.array(*[F.lit(level).cast("int") for level in sorted(used)]))).withColumn(
        "_bin", F.floor(F.col("_day") / F.expr("shiftleft(1, _level)"))
    )
    met = spread.join(placed, [*keys, "_level", "_bin"])
    return met.filter(F.col("_day").between(F.col("_start"), F.col("_end"))).drop("_day", "_start", "_end", "_level", "_bin")


def with_dated_season(tx: DataFrame, seasons: DataFrame, name: str = "in_season") -> DataFrame:
    """Transactions with a flag: the UTC day lies in a season of the table (first_day, last_day).

    Days are few, so the seasons are joined with the distinct days, and the flag with the rows.
    """
    days = tx.filter(F.col("timestamp").isNotNull()).select(F.to_date("timestamp").alias("season_day")).distinct()
    held = within(days, F.col("season_day"), seasons.select("first_day", "last_day"), []).select("season_day").distinct()
    held = settle(held, "season-days").withColumn("_held", F.lit(True))
    flagged = tx.join(held, F.to_date("timestamp") == F.col("season_day"), "left")
    return flagged.withColumn(name, F.coalesce("_held", F.lit(False))).drop("season_day", "_held")


def range_breaks(tx: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("transaction_type", "sender_wilaya")) -> DataFrame:
    """range_id, n, below and above: rows that each dated range holds, and those outside its amounts.

    ``ranges`` has range_id, the keys, first_day, last_day, low and high.
    """
    rows = tx.select(*keys, "amount", F.to_date("timestamp").alias("tx_day"))
    held = within(rows, F.col("tx_day"), ranges.select("range_id", *keys, "first_day", "last_day", "low", "high"), list(keys))
    return held.groupBy("range_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("amount") < F.col("low")).alias("below"),
        F.count_if(F.col("amount") > F.col("high")).alias("above"),
    )
