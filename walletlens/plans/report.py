"""All statistics of the validation report from one scan of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from walletlens.functions import (
    DEFAULT_SEASONS,
    Season,
    half_even,
    in_capital,
    in_capital_by_prefix,
    in_port,
    percent,
    truthy,
    tx_date,
)
from walletlens.operators import profile, validation
from walletlens.sources.work import settle


def profile_sets(tx: DataFrame) -> DataFrame:
    """Counts of every reported distribution as (metric, value, n), from one scan.

    The result has one row per distinct value and day, however large the table is.
    """
    columns = {name: F.col(name) for name in ("channel", "sender_wilaya", "transaction_type", "anomaly_type")}
    columns["is_anomaly"] = truthy(F.col("is_anomaly"))
    columns["tx_date"] = tx_date(F.col("timestamp"))
    columns["rows"] = F.lit("all")
    return profile.distributions(tx, columns)


def _metric(sets: DataFrame, name: str) -> DataFrame:
    return sets.filter(F.col("metric") == name).select("value", "n")


def _days(sets: DataFrame) -> DataFrame:
    days = _metric(sets, "tx_date").filter(F.col("value").isNotNull())
    return days.select(F.col("value").cast("date").alias("tx_date"), "n")


def _total(sets: DataFrame):
    return F.coalesce(F.sum(F.when(F.col("metric") == "rows", F.col("n"))), F.lit(0))


def _region_sum(condition):
    inside = (F.col("metric") == "sender_wilaya") & condition(F.col("value"))
    return F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0))


def _anomalies():
    labelled = (F.col("metric") == "is_anomaly") & truthy(F.col("value"))
    return F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0))


def _shares(sets: DataFrame, name: str) -> DataFrame:
    return profile.with_share(_metric(sets, name))


def report_from_sets(sets: DataFrame, seasons: Sequence[Season] = DEFAULT_SEASONS) -> dict[str, DataFrame]:
    """The distribution tables of the report, from the counts of ``profile_sets``."""
    by_count = [F.desc("n"), F.asc_nulls_last("value")]
    geo = sets.agg(
        _total(sets).alias("total"),
        _region_sum(in_capital).alias("capital"),
        _region_sum(in_port).alias("port"),
        _anomalies().alias("anomaly_count"),
    ).select(
        "total",
        "anomaly_count",
        percent(F.col("capital"), F.col("total")).alias("capital_percent"),
        percent(F.col("port"), F.col("total")).alias("port_percent"),
        percent(F.col("anomaly_count"), F.col("total")).alias("anomaly_percent"),
    )
    rest = half_even(F.lit(100.0) - F.col("capital_percent") - F.col("port_percent"), 2)
    days = _days(sets)
    return {
        "channel_share": _shares(sets, "channel").orderBy(*by_count),
        "geo_summary": geo.select(
            "capital_percent",
            "port_percent",
            F.when(F.col("total") == 0, F.lit(0.0)).otherwise(rest).alias("other_percent"),
        ),
        "top_regions": _shares(sets, "sender_wilaya").orderBy(*by_count).limit(10),
        "type_count": _metric(sets, "transaction_type").orderBy(*by_count),
        "anomaly_summary": geo.select("anomaly_count", "anomaly_percent"),
        "anomaly_type_count": _metric(sets, "anomaly_type").orderBy(*by_count),
        "daily_volume_summary": profile.daily_volume_summary(days),
        "season_compare": profile.season_compare(days, seasons),
        "salary_compare": profile.salary_compare(days),
    }


def validation_report(df: DataFrame, seasons: Sequence[Season] = DEFAULT_SEASONS) -> dict[str, DataFrame]:
    """Column check, row check and all distributions, in the order of the report.

    The counts are written once and every table below is read from that small table. A
    distribution whose column is missing is left out; the column check says so.
    """
    missing = set(validation.missing_columns(df))
    checked = {
        "column_check": validation.column_check(df),
        "row_validation": validation.row_validation(df),
        "failing_samples": validation.failing_samples(df),
    }
    # Anomalies are counted on the cells as they are: only ``true`` and ``1`` are anomalies.
    sets = settle(profile_sets(validation.canonical(df, raw=["is_anomaly"])), "profile")
    needs = {
        "channel_share": "channel",
        "geo_summary": "sender_wilaya",
        "top_regions": "sender_wilaya",
        "type_count": "transaction_type",
        "anomaly_summary": "is_anomaly",
        "anomaly_type_count": "anomaly_type",
        "daily_volume_summary": "timestamp",
        "season_compare": "timestamp",
        "salary_compare": "timestamp",
    }
    tables = report_from_sets(sets, seasons)
    return checked | {name: table for name, table in tables.items() if needs[name] not in missing}


def as_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables of a report as rows of (section, key, metric, value, text).

    The key is the first of value, label, column_name and transaction_id that a table has. Numbers
    and flags are values, other columns are texts.
    """
    keys = ("value", "label", "column_name", "transaction_id")
    parts = []
    for section, table in tables.items():
        key = next((name for name in keys if name in table.columns), None)
        cells = []
        for name, kind in table.dtypes:
            if name == key:
                continue
            number = kind in ("boolean", "int", "bigint", "double") or kind.startswith("decimal")
            value = F.col(name).cast("double") if number else F.lit(None).cast("double")
            text = F.lit(None).cast("string") if number else F.col(name).cast("string")
            cells.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), text.alias("text")))
        parts.append(
            table.select(
                F.lit(section).alias("section"),
                (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
                F.explode(F.array(*cells)).alias("cell"),
            ).select("section", "key", "cell.*")
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def basic_stats(tx: DataFrame) -> DataFrame:
    """The short statistics as rows of (section, value, metric), from one scan.

    Sections: rows, channels_percent, types_percent, capital_percent by name prefix,
    port_percent, top_regions_percent (the eight most frequent), anomaly_percent and
    anomaly_types_count. An empty table gives no rows.
    """
    sets = settle(profile_sets(tx), "profile")
    total = sets.filter(F.col("metric") == "rows").agg(F.sum("n")).scalar()
    labels = {
        "channel": "channels_percent",
        "transaction_type": "types_percent",
        "sender_wilaya": "top_regions_percent",
        "anomaly_type": "anomaly_types_count",
    }
    name = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    shares = sets.filter(F.col("metric").isin("channel", "transaction_type")).select(
        name[F.col("metric")].alias("section"), "value", percent(F.col("n"), total).alias("metric")
    )
    top = (
        _metric(sets, "sender_wilaya")
        .orderBy(F.desc("n"), F.asc_nulls_last("value"))
        .limit(8)
        .select(F.lit("top_regions_percent").alias("section"), "value", percent(F.col("n"), total).alias("metric"))
    )
    types = sets.filter(F.col("metric") == "anomaly_type").select(
        F.lit("anomaly_types_count").alias("section"), "value", F.col("n").cast("double").alias("metric")
    )
    single = sets.agg(
        _total(sets).alias("total"),
        _region_sum(in_capital_by_prefix).alias("capital"),
        _region_sum(in_port).alias("port"),
        _anomalies().alias("anomalies"),
    ).filter("total > 0")
    singles = single.select(
        F.col("total").cast("double").alias("rows"),
        percent(F.col("capital"), F.col("total")).alias("capital_percent"),
        percent(F.col("port"), F.col("total")).alias("port_percent"),
        percent(F.col("anomalies"), F.col("total")).alias("anomaly_percent"),
    ).unpivot([], ["rows", "capital_percent", "port_percent", "anomaly_percent"], "section", "metric")
    singles = singles.select("section", F.lit(None).cast("string").alias("value"), "metric")
    return shares.unionByName(top).unionByName(types).unionByName(singles)
