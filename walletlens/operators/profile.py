"""Counts, shares and period comparisons.

Groups are combined before the shuffle, so only (value, count) pairs travel and a value
that holds a third of all rows costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from walletlens.functions import (
    DEFAULT_SEASONS,
    Season,
    guarded_ratio,
    half_even,
    in_capital,
    in_capital_by_prefix,
    in_port,
    in_season,
    is_salary_day,
    percent,
    truthy,
    tx_date,
)


def value_count(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included, most frequent first; equal counts by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value"))


def with_share(counts: DataFrame, n: str = "n", share: str = "share") -> DataFrame:
    """Add the share of each row in the total of ``n``, in percent."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(share, percent(F.col(n), total))


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Share of all rows per value, null included, most frequent first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def share_by_key(df: DataFrame, column: str) -> DataFrame:
    return value_share(df, column).orderBy(F.asc_nulls_last("value"))


def top_values(df: DataFrame, column: str, rows: int) -> DataFrame:
    """The ``rows`` most frequent values and their shares of all rows."""
    return value_share(df, column).limit(rows)


def channel_share(df: DataFrame) -> DataFrame:
    return value_share(df, "channel")


def region_share(df: DataFrame) -> DataFrame:
    return value_share(df, "sender_wilaya")


def type_count(df: DataFrame) -> DataFrame:
    return value_count(df, "transaction_type")


def type_share(df: DataFrame) -> DataFrame:
    return share_by_key(df, "transaction_type")


def anomaly_type_count(df: DataFrame) -> DataFrame:
    return value_count(df, "anomaly_type").orderBy(F.asc_nulls_last("value"))


def _geo(df: DataFrame, capital: Column) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(capital).alias("capital"),
        F.count_if(in_port(F.col("sender_wilaya"))).alias("port"),
    )
    return counted.select(
        percent(F.col("capital"), F.col("total")).alias("capital_percent"),
        percent(F.col("port"), F.col("total")).alias("port_percent"),
        "total",
    )


def geo_summary(df: DataFrame) -> DataFrame:
    """Capital, port and other regions in percent; the rest is taken from the rounded values."""
    rest = half_even(F.lit(100.0) - F.col("capital_percent") - F.col("port_percent"), 2)
    return _geo(df, in_capital(F.col("sender_wilaya"))).select(
        "capital_percent",
        "port_percent",
        F.when(F.col("total") == 0, F.lit(0.0)).otherwise(rest).alias("other_percent"),
    )


def geo_summary_prefix(df: DataFrame) -> DataFrame:
    """Capital by the prefix of the region name, and port, in percent."""
    return _geo(df, in_capital_by_prefix(F.col("sender_wilaya"))).drop("total")


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Rows labelled as an anomaly, and their part of all rows in percent."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(truthy(F.col("is_anomaly"))).alias("anomaly_count")
    )
    return counted.select("anomaly_count", percent(F.col("anomaly_count"), F.col("total")).alias("anomaly_percent"))


def daily_volume(df: DataFrame) -> DataFrame:
    """Rows per UTC date in order; rows without a readable time and days without rows are absent."""
    return daily_counts(df).orderBy("tx_date")


def daily_counts(df: DataFrame) -> DataFrame:
    days = df.filter(F.col("timestamp").isNotNull()).groupBy(tx_date(F.col("timestamp")).alias("tx_date"))
    return days.agg(F.count(F.lit(1)).alias("n"))


def daily_volume_summary(daily: DataFrame) -> DataFrame:
    """Days, mean, least and greatest of a daily volume."""
    return daily.agg(
        F.count(F.lit(1)).alias("days"),
        guarded_ratio(F.sum("n"), F.count(F.lit(1))).alias("mean_rows"),
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
    )


def compare_periods(daily: DataFrame, inside: Column, inside_name: str, outside_name: str, ratio: str) -> DataFrame:
    """Daily averages of two periods and their ratio, from a daily volume.

    The averages are rounded first and the ratio is taken from them. A side without days
    counts as one day.
    """
    outside = ~inside
    sums = daily.agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("n_out"),
        F.greatest(F.count_if(inside), F.lit(1)).alias("days_in"),
        F.greatest(F.count_if(outside), F.lit(1)).alias("days_out"),
    )
    averages = sums.select(
        F.col("n_in").alias(f"{inside_name}_transactions"),
        F.col("n_out").alias(f"{outside_name}_transactions"),
        guarded_ratio(F.col("n_in"), F.col("days_in")).alias(f"{inside_name}_daily_avg"),
        guarded_ratio(F.col("n_out"), F.col("days_out")).alias(f"{outside_name}_daily_avg"),
    )
    return averages.withColumn(
        ratio, guarded_ratio(F.col(f"{inside_name}_daily_avg"), F.col(f"{outside_name}_daily_avg"))
    )


def season_compare(daily: DataFrame, seasons: Sequence[Season] = DEFAULT_SEASONS) -> DataFrame:
    return compare_periods(
        daily, in_season(F.col("tx_date"), seasons), "season", "other", "season_multiplier"
    )


def salary_compare(daily: DataFrame) -> DataFrame:
    return compare_periods(daily, is_salary_day(F.col("tx_date")), "salary", "other", "salary_multiplier")


def distributions(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows per (metric, value) for several columns in one scan and one shuffle.

    Each row is expanded to one (metric, value) pair per column and the pairs are counted
    before the shuffle. A null is a value of its metric.
    """
    texts = df.select(*[column.cast("string").alias(name) for name, column in columns.items()])
    pairs = texts.unpivot([], list(columns), "metric", "value")
    return pairs.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
