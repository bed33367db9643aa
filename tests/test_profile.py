from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from conftest import SMALL, found, typed_rows, utc
from walletlens.operators import behaviour, profile
from walletlens.plans import report
from walletlens.sources import dimensions
from walletlens.sources.event_log import LOG_SEASONS, load_transactions


def test_empty_tables(spark):
    empty = typed_rows(spark, {}).filter("false")
    assert tuple(profile.geo_summary(empty).first()) == (0.0, 0.0, 0.0)
    assert tuple(profile.anomaly_summary(empty).first()) == (0, 0.0)
    daily = profile.daily_counts(empty)
    assert tuple(profile.season_compare(daily).first()) == (0, 0, 0.0, 0.0, 0.0)
    assert tuple(profile.salary_compare(daily).first()) == (0, 0, 0.0, 0.0, 0.0)
    assert profile.channel_share(empty).count() == 0
    assert report.basic_stats(empty).count() == 0


def test_ties_do_not_depend_on_order(spark):
    rows = typed_rows(spark, *[{"channel": name} for name in ["USSD", "APP", None, "APP", "USSD", None, "AGENT"]])
    expected = [("APP", 2), ("USSD", 2), (None, 2), ("AGENT", 1)]
    for table in (rows, rows.orderBy(F.desc("transaction_id")), rows.repartition(5)):
        assert [tuple(row) for row in profile.value_count(table, "channel").collect()] == expected


def test_shares_and_rounding_order(spark):
    regions = ["Nouakchott-Sud"] * 2 + ["Dakhlet Nouadhibou"] * 2 + [None, "Trarza"]
    rows = typed_rows(spark, *[{"sender_wilaya": region} for region in regions])
    assert tuple(profile.geo_summary(rows).first()) == (33.33, 33.33, 33.34)
    assert [row.share for row in profile.region_share(rows).collect()] == [33.33, 33.33, 16.67, 16.67]


def test_period_comparison(spark):
    stamps = ["2026-02-17"] * 5 + ["2026-02-18"] * 4 + ["2026-04-01"] * 2 + ["2026-04-10"] * 2
    rows = typed_rows(spark, *[{"timestamp": utc(f"{day}T10:00:00")} for day in stamps], {"timestamp": None})
    daily = profile.daily_counts(rows)
    assert tuple(profile.season_compare(daily).first()) == (9, 4, 4.5, 2.0, 2.25)
    assert tuple(profile.salary_compare(daily).first()) == (2, 11, 2.0, 3.67, 0.54)
    assert tuple(profile.daily_volume_summary(daily).first()) == (4, 3.25, 2, 5)


def test_one_pass_equals_single_queries(spark):
    tx = load_transactions(spark, SMALL)
    tables = report.validation_report(tx, LOG_SEASONS)
    singles = {
        "channel_share": profile.channel_share(tx),
        "geo_summary": profile.geo_summary(tx),
        "top_regions": profile.top_values(tx, "sender_wilaya", 10),
        "type_count": profile.type_count(tx),
        "anomaly_summary": profile.anomaly_summary(tx),
        "anomaly_type_count": profile.value_count(tx, "anomaly_type"),
        "daily_volume_summary": profile.daily_volume_summary(profile.daily_counts(tx)),
        "season_compare": profile.season_compare(profile.daily_counts(tx), LOG_SEASONS),
        "salary_compare": profile.salary_compare(profile.daily_counts(tx)),
    }
    assert list(tables)[:3] == ["column_check", "row_validation", "failing_samples"]
    assert list(tables)[3:] == list(singles)
    for name, single in singles.items():
        assert [tuple(row) for row in tables[name].collect()] == [tuple(row) for row in single.collect()], name


def test_report_without_a_column(spark):
    tables = report.validation_report(typed_rows(spark, {}, {}).drop("channel"))
    assert "channel_share" not in tables and "type_count" in tables
    assert tables["column_check"].filter("state = 'MISSING'").count() == 1


def test_calendar_weights_of_a_year(spark):
    days = behaviour.seasonal_expectation(typed_rows(spark, {}), "2026-01-01", "2026-12-31")
    assert days.agg(F.round(F.sum("weight"), 4)).first()[0] == 464.0
    assert days.where("tx_date IS NOT NULL").count() == 365
    assert days.filter("tx_date = '2026-12-31'").first().running_share == 1.0


def test_fee_rule(spark):
    rows = typed_rows(
        spark,
        {"fees": "10.00"},
        {"fees": "5.00"},
        {"fees": "20.00"},
        {"fees": "4.99"},
        {"fees": "20.01"},
        {"transaction_type": "AIRTIME", "fees": "0.01"},
        {"transaction_type": "AIRTIME", "fees": "0.00"},
        {"status": "FAILED", "fees": "0.00"},
        {"fees": "0.00"},
        {"amount": "100.50", "fees": "0.50"},
    )
    got = {row.transaction_id: row.verdict for row in behaviour.fee_rule(rows).collect()}
    assert got == {"T0003": "TOO_LOW", "T0004": "TOO_HIGH", "T0005": "NOT_FREE", "T0008": "TOO_LOW"}


def test_amount_ranges(spark):
    rows = typed_rows(
        spark,
        {"amount": "80000.00"},
        {"amount": "80000.01"},
        {"transaction_type": "BILL_PAY", "bill_provider": "SNDE", "amount": "2000.01"},
        {"transaction_type": "BILL_PAY", "bill_provider": "MATTEL", "amount": "8000.00"},
        {"transaction_type": "CASH_IN", "origin_country": "FR", "amount": "4999.99"},
        {"transaction_type": "CASH_IN", "amount": "500.00"},
    )
    assert found(behaviour.amount_range(rows), "transaction_id", "side") == [
        ("T0001", "ABOVE"), ("T0002", "ABOVE"), ("T0004", "BELOW"),
    ]


def test_accounts(spark):
    rows = typed_rows(
        spark,
        *[{"sender_id": "A", "receiver_id": "B", "channel": channel} for channel in ("USSD", "APP", "APP", "USSD")],
        {"sender_id": "A", "receiver_id": "A", "sender_wilaya": "Inchiri"},
        {"sender_id": "C", "receiver_id": "A"},
    )
    profile_rows = {row.account_id: row for row in behaviour.account_profile(rows).collect()}
    assert (profile_rows["A"].sent_rows, profile_rows["A"].received_rows) == (5, 2)
    assert (profile_rows["A"].modal_channel, profile_rows["A"].modal_region) == ("USSD", "Nouakchott-Ouest")
    assert (profile_rows["B"].sent_rows, profile_rows["B"].modal_channel) == (0, None)
    assert profile_rows["A"].tier == "HIGH" and profile_rows["B"].tier == "LOW"
    assert found(behaviour.account_consistency(rows), "sender_id", "regions", "operators") == [("A", 2, 1)]
    assert found(behaviour.counterparties(rows), "account_id", "self_transfers", "counterparties") == [
        ("A", 1, 2), ("B", 0, 1), ("C", 0, 1),
    ]
    loyalty = {row.sender_id: (row.channel, row.loyalty) for row in behaviour.channel_loyalty(rows).collect()}
    assert loyalty["A"] == ("USSD", 60.0)


def test_rows_without_a_sender_count(spark):
    rows = typed_rows(
        spark, {"sender_id": None}, {"sender_id": None, "receiver_id": None}, {"sender_id": "ACC_00009", "receiver_id": None}
    )
    accounts = {row.account_id: row for row in behaviour.account_profile(rows).collect()}
    assert sum(row.sent_rows for row in accounts.values()) == 3 == sum(row.received_rows for row in accounts.values())
    assert (accounts[None].sent_rows, accounts[None].received_rows, accounts[None].modal_channel) == (2, 2, "USSD")


def test_rows_outside_the_calendar_are_counted(spark):
    rows = typed_rows(spark, {}, {"timestamp": None}, {"timestamp": utc("2020-01-01T00:00:00")})
    days = {row.tx_date: row.observed_rows for row in behaviour.seasonal_expectation(rows, "2026-04-09", "2026-04-11").collect()}
    assert len(days) == 4 and sum(days.values()) == 3 and days[None] == 2


def test_fixed_tables():
    """Sums and bounds that the definitions give, apart from the code that uses them."""
    for mix, shares in dimensions.EXPECTED_MIXES.items():
        # The region weights are fixed values that sum to 101.
        whole = 101 if mix == "sender_wilaya" else 100
        assert sum(shares.values()) == pytest.approx(whole), mix
    for key, (low, high) in dimensions.AMOUNT_RANGES.items():
        assert 0 < float(low) < float(high) <= 500_000, key
