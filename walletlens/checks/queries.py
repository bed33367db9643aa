"""Queries by name; each takes a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from walletlens import contract, functions as fn
from walletlens.operators import behaviour, circles, detectors, intervals, labels, profile, sketches, validation
from walletlens.plans import report
from walletlens.plans.incremental import ProfileState
from walletlens.plans.session import prepare, prepare_stream
from walletlens.sources import files, publish
from walletlens.sources.event_log import (
    LOG_FIRST_DAY,
    LOG_LAST_DAY,
    LOG_SEASONS,
    load_raw_text,
    load_transactions,
    raw_text_from_events,
    transactions_from_events,
)
from walletlens.sources.work import new_folder, settle
from walletlens.streaming import closed, operators as streams
from walletlens.streaming.sinks import run_append, run_complete, run_update

Query = Callable[[SparkSession, str], DataFrame]

# The mapped log is sparser than a wallet network, so the frames are wider here.
STRUCTURING = detectors.Structuring(seconds=10 * 86400, least_rows=2, variation="0.5", least_total="1000")
HIGH_FREQUENCY = detectors.HighFrequency(seconds=86400, least_rows=4)
RECEIVER_BURST = detectors.HighFrequency(key=("receiver_id",), seconds=86400, least_rows=4)
TONTINE = detectors.Tontine(seconds=48 * 3600, least_members=3, same_day=False)
DAY_CIRCLE = detectors.Tontine(seconds=86400, least_members=2)
ROTATION = circles.Rotation(similarity=25)
OUTAGE = detectors.Outage(seconds=86400, least_rate=10.0)
LIMITS = labels.Limits(STRUCTURING, HIGH_FREQUENCY, OUTAGE)
# Cells of a row that the circle operators do not filter out.
A_TRANSFER = {"transaction_type": "TRANSFER"}


def _on_tx(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(load_transactions(prepare(spark), folder))


def _on_raw(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(load_raw_text(prepare(spark), folder))


def _events_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/events.parquet"
    schema = prepare_stream(spark).read.parquet(path).schema
    # As a pattern the path may be one file or a folder of files.
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]")


def _on_stream(run: Callable[[DataFrame], DataFrame], raw: bool = False) -> Query:
    reader = raw_text_from_events if raw else transactions_from_events
    return lambda spark, folder: run(reader(_events_stream(spark, folder)))


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the rows that stay; a row that is not wholly a row of the table would be missing."""
    kept = run_append(streams.stream_dedup(transactions_from_events(_events_stream(spark, folder))), "stream-ids")
    return kept.intersect(load_transactions(spark, folder)).select("transaction_id")


def tontine_estimate_check(spark: SparkSession, folder: str) -> DataFrame:
    """Closed circles with their exact members, and whether the estimate of each is near it.

    The exact count is that of the batch; a window of at most 16 members is estimated within one.
    """
    stream = transactions_from_events(_events_stream(spark, folder))
    keys = ["receiver_id", "amount", "window_start", "window_end"]
    least = TONTINE._replace(least_members=1)
    estimate = run_update(
        streams.stream_tontine_estimate(stream, least, "60 hours", "12 hours"), "stream-tontine-estimate", keys
    )
    exact = run_complete(
        lambda tx: streams.stream_tontine(tx, TONTINE, "60 hours", "12 hours"), stream, "stream-tontine", A_TRANSFER
    )
    near = F.abs(F.col("estimate") - F.col("members")) <= F.greatest(F.lit(1.0), 0.1 * F.col("members"))
    return exact.join(estimate.withColumnRenamed("members", "estimate"), keys, "left").select(
        *keys, "members", F.coalesce(near, F.lit(False)).alias("within_error")
    )


def stale_season_flags(tx: DataFrame) -> DataFrame:
    """Season flags of the log's own season; each 100th row has a stale one."""
    stale = F.col("transaction_id").endswith("00")
    flagged = tx.withColumn("is_ramadan", F.when(stale, ~F.col("is_ramadan")).otherwise(F.col("is_ramadan")))
    return validation.season_flag_mismatches(flagged, LOG_SEASONS)


def _daily(tx: DataFrame) -> DataFrame:
    return profile.daily_counts(tx)


def scalar_columns(tx: DataFrame) -> DataFrame:
    """Every column function on every row."""
    stamp, region = F.col("timestamp"), F.col("sender_wilaya")
    return tx.select(
        "transaction_id",
        fn.money(F.col("amount") * F.lit("0.0175").cast("decimal(5,4)")).alias("charge"),
        fn.in_season(stamp, LOG_SEASONS).alias("in_season"),
        fn.season_weight(stamp, LOG_SEASONS).alias("season_weight"),
        fn.is_salary_day(stamp).alias("salary_day"),
        fn.salary_weight(stamp).alias("salary_weight"),
        fn.is_diaspora_weekend(stamp).alias("weekend"),
        fn.in_day_range(stamp, "2024-01-05", "2024-01-09").alias("in_days"),
        fn.utc_timestamp(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("parsed_time"),
        fn.tx_date(stamp).alias("tx_date"),
        fn.day_of_month(stamp).alias("day_of_month"),
        fn.truthy(F.upper(F.col("is_anomaly").cast("string"))).alias("anomaly"),
        fn.in_capital(region).alias("in_capital"),
        fn.in_capital_by_prefix(region).alias("in_capital_prefix"),
        fn.in_port(region).alias("in_port"),
        fn.is_rural(region).alias("rural"),
        F.round(fn.fee_rate(F.col("fees"), F.col("amount")), 6).alias("fee_rate"),
        fn.account_id(F.substr(F.col("sender_id"), F.lit(5)).cast("int")).alias("account_key"),
    )


def rows_in_days(tx: DataFrame) -> DataFrame:
    return tx.filter(fn.in_day_range(F.col("timestamp"), "2024-01-05", "2024-01-09"))


def violations_text(df: DataFrame) -> DataFrame:
    """Each failing row with the names of its rules."""
    return validation.failing_rows(df).select(
        "transaction_id", "timestamp", F.array_join(F.array_sort("violations"), ",").alias("reasons")
    )


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("violations", F.array_join(F.array_sort("violations"), ","))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows of both routes, read back from where they were written."""
    path = validation.write_routes(df, new_folder(df.sparkSession, "routes"))
    return _as_text(df.sparkSession.read.parquet(path))


def quarantine_stream(df: DataFrame) -> DataFrame:
    return _as_text(run_append(streams.stream_validate(df), "stream-routes", ["route"]))


def missing_column_defaults(df: DataFrame) -> DataFrame:
    """Row check of a source without the columns that have a default."""
    return validation.row_validation(df.drop("currency", "status", "transaction_id"))


def canonical_text(df: DataFrame) -> DataFrame:
    return files.canonical_text(validation.canonical(df))


def _round_trip(extension: str, **options) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tx = load_transactions(prepare(spark), folder)
        path = new_folder(spark, "round-trip") + extension
        files.write_transactions(tx, path)
        return validation.canonical(files.read_transactions(spark, path, **options))

    return run


def _text_round_trip(extension: str, **options) -> Query:
    """Text rows with all their defects through a text sink, read back and made canonical."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_folder(spark, "text-round-trip") + extension
        raw = load_raw_text(prepare(spark), folder)
        files.write_transactions(raw, path, multi_line=True)
        return canonical_text(files.read_transactions(spark, path, multi_line=True, **options))

    return run


def parquet_by_date(tx: DataFrame) -> DataFrame:
    """Typed Parquet in date folders; only the wanted days are read."""
    spark = tx.sparkSession
    path = files.write_parquet(tx, new_folder(spark, "by-date"), by_date=True)
    days = F.col("tx_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date"))
    return spark.read.parquet(path).filter(days).drop("tx_date")


def appended(tx: DataFrame) -> DataFrame:
    """Two batches in one table, counted by status; a row without a time is in the second."""
    is_early = F.coalesce(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"), F.lit(False))
    early, late = tx.filter(is_early), tx.filter(~is_early)
    return profile.value_count(early.unionByName(late, allowMissingColumns=False), "status")


def first_rows(tx: DataFrame) -> DataFrame:
    """An exact number of rows in a stated order."""
    return tx.orderBy("timestamp", "transaction_id").limit(100).select("transaction_id", "timestamp")


def report_row(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda tx: report.report_from_sets(settle(report.profile_sets(tx), "profile"), LOG_SEASONS)[name]


def report_rows(tx: DataFrame) -> DataFrame:
    """The whole report as rows of (table, key, metric, value)."""
    return report.as_rows(report.validation_report(tx, LOG_SEASONS))


def tontine_suppressed(tx: DataFrame) -> DataFrame:
    """Bursts towards one receiver that no savings circle explains."""
    return detectors.without_tontines(detectors.high_frequency(tx, RECEIVER_BURST), tx, TONTINE)


def _followed(watch: closed.Watch, label: str) -> Callable[[DataFrame], DataFrame]:
    return lambda tx: closed.run_closed(watch, closed.account_columns(tx), label)


def incremental_profile(tx: DataFrame) -> DataFrame:
    """Every reported distribution of a dated table that was loaded in three parts, each counted once.

    The second load appends days, the third adds late rows to days that are there; rows without a
    time come first.
    """
    spark = tx.sparkSession
    path, state = new_folder(spark, "dated-loads"), ProfileState.new(spark)
    is_early = F.coalesce(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"), F.lit(True))
    late = F.col("transaction_id").endswith("7") & is_early
    for part in (is_early & ~late, ~is_early, late):
        files.write_parquet(tx.filter(part), path, mode="append", by_date=True)
        state.refresh(path)
    return state.sets()


def sketched_quantiles(tx: DataFrame) -> DataFrame:
    """Rows of each type, and whether the sketched quantiles of its amounts have the wanted ranks within
    twice the error that holds with 99 percent."""
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    stored = settle(sketches.day_sketches(tx, ["transaction_type"], "amount"), "sketches")
    found = settle(sketches.quantiles_of(stored, ["transaction_type"], wanted), "quantiles")
    rows = tx.filter("amount IS NOT NULL").select("transaction_type", F.col("amount").cast("double").alias("amount"))
    both = rows.join(
        found.withColumnRenamed("transaction_type", "kind"), F.col("transaction_type").eqNullSafe(F.col("kind"))
    )
    ranks = both.groupBy("transaction_type", "n").agg(
        *[F.count_if(F.col("amount") < F.col(name)).alias(f"{name}_below") for name in wanted],
        *[F.count_if(F.col("amount") <= F.col(name)).alias(f"{name}_upto") for name in wanted],
    )
    slack = F.lit(2 * sketches.rank_error()) * F.col("n") + 1
    return ranks.select(
        "transaction_type", "n",
        *[
            ((F.col(f"{name}_below") - slack <= part * F.col("n")) & (part * F.col("n") <= F.col(f"{name}_upto") + slack)).alias(name)
            for name, part in wanted.items()
        ],
    )


def dated_range_breaks(tx: DataFrame) -> DataFrame:
    """Each day's range of amounts of a type and region, valid for up to 19 more days, against all rows."""
    day = F.to_date("timestamp").alias("first_day")
    ranges = tx.groupBy("transaction_type", "sender_wilaya", day).agg(
        F.min("amount").alias("low"), F.max("amount").alias("high"), F.count(F.lit(1)).alias("n")
    )
    dated = ranges.withColumn("last_day", F.date_add("first_day", F.pmod("n", F.lit(20)).cast("int"))).withColumn(
        "range_id", F.concat_ws("|", "transaction_type", "sender_wilaya", F.col("first_day").cast("string"))
    )
    return intervals.range_breaks(tx, dated)


def dated_seasons(tx: DataFrame) -> DataFrame:
    """Rows per day inside and outside of seasons from a table: each busy day and the next three."""
    daily = settle(profile.daily_counts(tx), "days")
    busy = daily.filter(F.col("n") > daily.agg(F.avg("n")).scalar())
    seasons = busy.select(F.col("tx_date").alias("first_day"), F.date_add("tx_date", 3).alias("last_day"))
    flagged = intervals.with_dated_season(tx.select("timestamp"), seasons)
    return flagged.groupBy(F.to_date("timestamp").alias("tx_date"), "in_season").agg(F.count(F.lit(1)).alias("n"))


def published_stream_routes(df: DataFrame) -> DataFrame:
    """Rows of both sinks of a stream that publishes them together."""
    publication = publish.publish_routes(df, new_folder(df.sparkSession, "publish"))
    return _as_text(publish.published_routes(publication, validation.with_route(df).schema))


def label_scorecard(tx: DataFrame) -> DataFrame:
    return labels.label_scorecard(labels.rule_label(tx, LIMITS))


def alerted_account_rows(tx: DataFrame) -> DataFrame:
    alerts = detectors.structuring(tx, STRUCTURING)
    columns = ["transaction_id", "timestamp", "sender_id", "receiver_id", "amount"]
    return detectors.rows_of_alerted(tx.select(*columns), alerts)


def _named(query: Query, name: str) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder)

    run.__name__ = name
    return run


def all_queries() -> dict[str, Query]:
    on_tx = {
        # distributions
        "value_share_channel": profile.channel_share,
        "value_share_region": profile.region_share,
        "geo_summary": profile.geo_summary,
        "geo_summary_prefix": profile.geo_summary_prefix,
        "type_count": profile.type_count,
        "type_share": profile.type_share,
        "anomaly_summary": profile.anomaly_summary,
        "anomaly_type_count": profile.anomaly_type_count,
        "daily_volume": profile.daily_volume,
        "daily_volume_summary": lambda tx: profile.daily_volume_summary(_daily(tx)),
        "season_compare": lambda tx: profile.season_compare(_daily(tx), LOG_SEASONS),
        "salary_compare": lambda tx: profile.salary_compare(_daily(tx)),
        "profile_sets": report.profile_sets,
        "basic_stats": report.basic_stats,
        "validation_report": report_rows,
        "report_channel_share": report_row("channel_share"),
        "report_geo_summary": report_row("geo_summary"),
        "report_season_compare": report_row("season_compare"),
        "report_salary_compare": report_row("salary_compare"),
        "report_daily_summary": report_row("daily_volume_summary"),
        "top_regions": lambda tx: profile.top_values(tx, "sender_wilaya", 8),
        "top_ten_regions": lambda tx: profile.top_values(tx, "sender_wilaya", 10),
        # contract
        "column_check": validation.column_check,
        "row_validation": validation.row_validation,
        "violations_by_rule": validation.violations_by_rule,
        "row_violations": violations_text,
        "failing_samples": validation.failing_samples,
        "quarantine": quarantine,
        "duplicate_ids": validation.duplicate_ids,
        "season_flag_check": stale_season_flags,
        "missing_column_defaults": missing_column_defaults,
        # functions, sources, set operations
        "scalar_columns": scalar_columns,
        "rows_in_days": rows_in_days,
        "parquet_by_date": parquet_by_date,
        "appended_batches": appended,
        "first_rows": first_rows,
        # behaviour
        "mix_drift": behaviour.mix_drift,
        "seasonal_expectation": lambda tx: behaviour.seasonal_expectation(
            tx, LOG_FIRST_DAY, LOG_LAST_DAY, LOG_SEASONS
        ),
        "amount_range": behaviour.amount_range,
        "fee_rule": behaviour.fee_rule,
        "fee_rate_profile": behaviour.fee_rate_profile,
        "hourly_profile": lambda tx: behaviour.hourly_profile(tx, LOG_SEASONS),
        "evening_share": lambda tx: behaviour.evening_share(tx, LOG_SEASONS),
        "type_mix_by_day_class": behaviour.type_mix_by_day_class,
        "channel_mix_by_region_class": behaviour.channel_mix_by_region_class,
        "recurring_bills": behaviour.recurring_bills,
        "bill_payer_share": behaviour.bill_payer_share,
        "bill_day_profile": behaviour.bill_day_profile,
        "account_profile": behaviour.account_profile,
        "account_consistency": behaviour.account_consistency,
        "channel_loyalty": behaviour.channel_loyalty,
        "counterparties": behaviour.counterparties,
        "diaspora_flow": behaviour.diaspora_flow,
        "corridors": behaviour.corridors,
        "corridor_matrix": behaviour.corridor_matrix,
        "operator_indicators": behaviour.operator_indicators,
        # detectors
        "high_amount": detectors.high_amount,
        "structuring": lambda tx: detectors.structuring(tx, STRUCTURING),
        "high_frequency": lambda tx: detectors.high_frequency(tx, HIGH_FREQUENCY),
        "operator_outage": lambda tx: detectors.operator_outage(tx, OUTAGE),
        "unusual_location": detectors.unusual_location,
        "tontine": lambda tx: detectors.tontine(tx, TONTINE),
        "tontine_suppressed": tontine_suppressed,
        "rule_label": lambda tx: labels.rule_label(tx, LIMITS).select(
            "transaction_id", "timestamp", "anomaly_type", "rule_label", "rule_flag"
        ),
        "sketched_quantiles": sketched_quantiles,
        "dated_range_breaks": dated_range_breaks,
        "dated_seasons": dated_seasons,
        "circle_turns": lambda tx: circles.circle_turns(tx, DAY_CIRCLE, ROTATION),
        "savings_circles": lambda tx: circles.savings_circles(tx, DAY_CIRCLE, ROTATION),
        "incremental_profile": incremental_profile,
        "label_scorecard": label_scorecard,
        "alerted_account_rows": alerted_account_rows,
    }
    on_raw = {
        "text_row_validation": validation.row_validation,
        "text_violations_by_rule": validation.violations_by_rule,
        "text_row_violations": violations_text,
        "text_unreadable_timestamps": validation.unreadable_timestamps,
        "text_canonical": canonical_text,
        "text_quarantine": quarantine,
    }
    on_stream = {
        "stream_daily": lambda tx: run_update(
            streams.stream_volume(tx), "stream-daily", ["window_start", "window_end"]
        ),
        "stream_hourly": lambda tx: run_update(
            streams.stream_volume(tx, "1 hour"), "stream-hourly", ["window_start", "window_end"]
        ),
        "stream_outage": lambda tx: run_update(
            streams.stream_outage(tx, OUTAGE), "stream-outage", ["operator", "window_start", "window_end"]
        ),
        "stream_burst": lambda tx: run_update(
            streams.stream_burst(tx, HIGH_FREQUENCY, "30 hours", "6 hours"),
            "stream-burst",
            ["sender_id", "window_start", "window_end"],
        ),
        "stream_tontine": lambda tx: run_complete(
            lambda rows: streams.stream_tontine(rows, TONTINE, "60 hours", "12 hours"), tx, "stream-tontine", A_TRANSFER
        ),
        "stream_exact_burst": _followed(closed.bursts(HIGH_FREQUENCY), "stream-exact-burst"),
        "stream_exact_split": _followed(closed.split_payments(STRUCTURING), "stream-exact-split"),
        "stream_exact_tontine": _followed(closed.circles(TONTINE), "stream-exact-tontine"),
        "stream_exact_suppressed": _followed(
            closed.unexplained_bursts(RECEIVER_BURST, TONTINE), "stream-exact-suppressed"
        ),
        "stream_sessions": lambda tx: run_complete(streams.stream_sessions, tx, "stream-sessions"),
    }
    found = {name: _on_tx(operator) for name, operator in on_tx.items()}
    found |= {name: _on_raw(operator) for name, operator in on_raw.items()}
    found |= {name: _on_stream(run) for name, run in on_stream.items()}
    found["stream_dedup"] = stream_dedup
    found["stream_tontine_estimate"] = tontine_estimate_check
    found["stream_published_routes"] = _on_stream(published_stream_routes)
    found["stream_validate"] = _on_stream(quarantine_stream)
    found["text_stream_validate"] = _on_stream(quarantine_stream, raw=True)
    found["csv_round_trip"] = _round_trip(".csv")
    found["json_round_trip"] = _round_trip(".json", columns=contract.COLUMNS)
    found["text_csv_round_trip"] = _text_round_trip(".csv")
    found["text_json_round_trip"] = _text_round_trip(".json", columns=contract.COLUMNS)
    found["parquet_round_trip"] = _round_trip(".parquet")
    return {name: _named(query, name) for name, query in found.items()}
