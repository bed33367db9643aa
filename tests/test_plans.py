"""Plans that the design relies on: few scans, pruned columns, no collected groups."""

from __future__ import annotations

import glob
import os
import re

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from conftest import SMALL, text_rows, typed_rows
from walletlens.checks.oracles import all_oracles
from walletlens.checks.queries import all_queries
from walletlens.functions import in_day_range
from walletlens.operators import behaviour, detectors, profile, validation
from walletlens.operators.quantiles import exact_quantiles
from walletlens.plans import report
from walletlens.sources import files
from walletlens.sources.event_log import load_transactions
from walletlens.sources.work import new_folder, settle, work_folder, work_scope

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def stored(spark):
    """The typed transactions as a Parquet table."""
    return settle(load_transactions(spark, SMALL), "stored")


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read_columns(text):
    import re

    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", text)]


def test_only_needed_columns_are_read(stored):
    assert read_columns(plan(profile.geo_summary(stored))) == [{"sender_wilaya"}]
    assert read_columns(plan(profile.daily_counts(stored))) == [{"timestamp"}]
    assert source_columns(behaviour.corridors, stored) == [{"sender_wilaya", "receiver_wilaya", "amount"}]
    assert read_columns(plan(behaviour.operator_indicators(stored))) == [{"operator", "amount", "fees", "status"}]


def test_filters_reach_the_scan(stored):
    text = formatted(stored.filter(in_day_range(F.col("timestamp"), "2024-01-05", "2024-01-09")))
    assert "GreaterThanOrEqual(timestamp" in text and "LessThanOrEqual(timestamp" in text
    assert "EqualTo(transaction_type,BILL_PAY)" in plan(behaviour.recurring_bills(stored))


def test_dates_prune_folders(spark, stored):
    path = files.write_parquet(stored, new_folder(spark, "dated"), by_date=True)
    text = plan(spark.read.parquet(path).filter("tx_date = DATE '2024-01-05'"))
    assert "PartitionFilters: [isnotnull(tx_date" in text
    assert len(glob.glob(f"{path}/tx_date=*")) == 30


def test_one_scan_for_all_distributions(stored):
    text = plan(report.profile_sets(stored))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert plan(behaviour.mix_drift(stored)).count("FileScan") == 1
    assert plan(validation.violations_by_rule(stored)).count("FileScan") == 1


def test_shares_scan_once(stored):
    assert "ReusedExchange" in final_plan(profile.channel_share(stored))
    assert "ReusedExchange" in final_plan(
        exact_quantiles(stored, ["transaction_type"], "amount", {"mid": 0.5})
    )


def test_joins_follow_the_size_of_the_written_side(spark, stored):
    def joined():
        return plan(detectors.unusual_location(stored))

    assert "BroadcastHashJoin" in joined()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in joined()
        large = [tuple(row) for row in detectors.unusual_location(stored).orderBy("transaction_id").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    small = [tuple(row) for row in detectors.unusual_location(stored).orderBy("transaction_id").collect()]
    assert large == small and large


def test_detectors_agree_without_broadcast(spark, stored):
    limits = detectors.Tontine(seconds=48 * 3600, least_members=2, same_day=False)
    small = sorted(tuple(row) for row in detectors.tontine(stored, limits).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        large = sorted(tuple(row) for row in detectors.tontine(stored, limits).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert small == large and small


def test_plans_hold_no_cross_join_and_no_python(spark, stored):
    for run in (
        report.profile_sets, behaviour.mix_drift, behaviour.counterparties, behaviour.fee_rate_profile,
        detectors.high_amount, detectors.structuring, detectors.high_frequency, detectors.tontine,
        detectors.unusual_location, validation.validate,
    ):
        text = plan(run(stored))
        for name in ("CartesianProduct", "NestedLoopJoin", "Python", "MapInPandas", "ArrowEval"):
            assert name not in text, (run, name)


def test_library_avoids_driver_work():
    banned = ("localCheckpoint", ".collect(", ".toPandas(", "crossJoin", "collect_list", "collect_set", ".rdd", "udf(")
    for path in glob.glob(f"{ROOT}/walletlens/**/*.py", recursive=True):
        # Bounded lists of operators on texts are tested with them.
        if path.endswith("checks/compare.py") or "/llm/" in path:
            continue
        text = open(path, encoding="utf-8").read()
        assert not [word for word in banned if word in text], path


def test_methods_stay_small_enough_to_compile(spark, stored):
    """The JVM does not compile a method above 8,000 bytes of byte code."""
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for run in (validation.validate, validation.row_validation, validation.violations_by_rule,
                    validation.failing_rows, behaviour.fee_rule, report.profile_sets):
            df = run(stored)
            text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]
            assert sizes and all(0 < size < 8000 for size in sizes), (run, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def noted_plans(run, stored):
    """The plans of all jobs that a run starts, and of its result."""
    seen = []
    plain = DataFrameWriter.parquet

    def note(writer, path, *rest, **more):
        seen.append(plan(writer._df))
        return plain(writer, path, *rest, **more)

    DataFrameWriter.parquet = note
    try:
        seen.append(plan(run(stored)))
    finally:
        DataFrameWriter.parquet = plain
    return seen


def source_folder(stored):
    return os.path.basename(stored.inputFiles()[0].rsplit("/", 1)[0])


def source_scans(run, stored, folder):
    """How often a run reads the files of ``stored``, in all jobs that it starts."""
    return sum(len(re.findall(f"FileScan parquet [^\n]*{folder}", text)) for text in noted_plans(run, stored))


def source_columns(run, stored):
    """The columns of each scan of the files of ``stored``."""
    scans = [line for text in noted_plans(run, stored) for line in text.split("\n") if "FileScan" in line]
    return [columns for line in scans if source_folder(stored) in line for columns in read_columns(line)]


def test_detectors_read_the_source_seldom(stored):
    folder = source_folder(stored)
    circle = detectors.Tontine(seconds=48 * 3600, least_members=3)
    assert source_scans(detectors.structuring, stored, folder) <= 2
    assert source_scans(detectors.high_frequency, stored, folder) <= 2
    assert source_scans(lambda tx: detectors.tontine(tx, circle), stored, folder) <= 2
    suppressed = lambda tx: detectors.without_tontines(detectors.high_frequency(tx), tx, circle)
    assert source_scans(suppressed, stored, folder) <= 4


def test_a_season_is_compared_in_one_scan(stored):
    run = lambda tx: behaviour.seasonal_expectation(tx, "2024-01-01", "2024-01-10")
    assert source_columns(run, stored) == [{"timestamp"}]


def test_a_filter_before_the_row_check_reaches_the_scan(stored):
    late = F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp")
    text = formatted(validation.failing_rows(stored, where=late))
    assert "GreaterThanOrEqual(timestamp" in text
    assert validation.failing_rows(stored, where=late).count() == validation.failing_rows(stored).filter(late).count()


def test_names_are_checked_without_a_scan(spark):
    rows = typed_rows(spark, {}).drop("fees").withColumn("a.b", F.lit(1))
    states = validation.column_states(rows)
    assert (states["fees"], states["a.b"], states["amount"]) == ("MISSING", "EXTRA", "REQUIRED")
    checked = {row.column_name: (row.state, row.filled_cells) for row in validation.column_check(rows).collect()}
    assert (checked["a.b"], checked["fees"]) == (("EXTRA", 1), ("MISSING", 0))


def test_a_scope_deletes_what_was_made_in_it(spark):
    with work_scope(spark):
        inner = new_folder(spark, "scope")
        spark.range(3).write.parquet(inner)
        assert os.path.exists(inner.removeprefix("file://"))
    assert not os.path.exists(inner.removeprefix("file://"))


def test_the_report_counts_anomalies_as_they_are_written(spark):
    rows = text_rows(spark, {"is_anomaly": "yes"}, {"is_anomaly": "1"}, {"is_anomaly": "false"}, {"is_anomaly": "TRUE"})
    summary = report.validation_report(rows)["anomaly_summary"].first()
    assert summary.anomaly_count == 2
    kinds = dict(report.as_rows(report.validation_report(rows)).dtypes)
    assert kinds == {"section": "string", "key": "string", "metric": "string", "value": "double", "text": "string"}


def test_work_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        assert new_folder(spark, "x").startswith(folder.rstrip("/"))
    assert work_folder(spark) == work_folder(spark)


def test_sql_for_all():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_oracles()) <= set(all_queries())


def test_typed_input_is_left_alone(spark):
    rows = typed_rows(spark, {})
    assert validation.canonical(rows).schema == rows.schema
