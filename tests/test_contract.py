from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import text_rows, typed_rows
from walletlens import contract
from walletlens.operators import validation as v

BAD_ROWS = [
    ("TS_NULL", {"timestamp": None}),
    ("TS_NULL", {"timestamp": "  "}),
    ("TS_PARSE", {"timestamp": "yesterday"}),
    ("TS_PARSE", {"timestamp": "2026-13-40T00:00:00+00:00"}),
    ("TS_NO_TZ", {"timestamp": "2026-02-20T21:15:00"}),
    ("TS_NOT_UTC", {"timestamp": "2026-02-20T21:15:00+01:00"}),
    ("ID_NULL", {"transaction_id": ""}),
    ("SENDER_FMT", {"sender_id": "ACC_0001"}),
    ("SENDER_FMT", {"sender_id": "ACC_00001\n"}),
    ("SENDER_FMT", {"sender_id": None}),
    ("RECEIVER_FMT", {"receiver_id": "acc_00002"}),
    ("AMOUNT_NULL", {"amount": "many"}),
    ("AMOUNT_MAX", {"amount": "500000.01"}),
    ("AMOUNT_SCALE", {"amount": "15000.005"}),
    ("FEES_NULL", {"fees": None}),
    ("FEES_NEG", {"fees": "-0.01"}),
    ("FEES_SCALE", {"fees": "0.001"}),
    ("CURRENCY_ENUM", {"currency": "EUR"}),
    ("CURRENCY_ENUM", {"currency": None}),
    ("CHANNEL_ENUM", {"channel": "WEB"}),
    ("OPERATOR_ENUM", {"operator": "bankily"}),
    ("STATUS_ENUM", {"status": "DONE"}),
    ("SENDER_WILAYA_ENUM", {"sender_wilaya": "Atlantis"}),
    ("RECEIVER_WILAYA_ENUM", {"receiver_wilaya": None}),
    ("RAMADAN_BOOL", {"is_ramadan": "maybe"}),
    ("ANOMALY_BOOL", {"is_anomaly": None}),
    ("ANOMALY_TYPE_ENUM", {"anomaly_type": None}),
    ("PROVIDER_ENUM", {"transaction_type": "BILL_PAY", "bill_provider": "ACME"}),
    ("ORIGIN_FMT", {"transaction_type": "CASH_IN", "origin_country": "fr"}),
    ("SELF_TRANSFER", {"receiver_id": "ACC_00001"}),
    ("FEES_GT_AMOUNT", {"amount": "100.00", "fees": "100.01"}),
    ("BILL_PROVIDER_MISSING", {"transaction_type": "BILL_PAY"}),
    ("BILL_PROVIDER_UNEXPECTED", {"bill_provider": "SNDE"}),
    ("ORIGIN_UNEXPECTED", {"origin_country": "FR"}),
    ("ANOMALY_TYPE_MISSING", {"is_anomaly": "true"}),
    ("ANOMALY_TYPE_UNEXPECTED", {"anomaly_type": "STRUCTURING"}),
]
GOOD_ROWS = [
    {},
    {"timestamp": "2026-02-20T21:15:00Z"},
    {"timestamp": "2026-02-20 21:15:00.250-00:00"},
    {"amount": "500000.00"},
    {"amount": "1.10", "fees": "1.10"},
    {"transaction_type": "CASH_IN"},
    {"transaction_type": "CASH_IN", "origin_country": "FR"},
    {"transaction_type": "BILL_PAY", "bill_provider": "MATTEL"},
    {"is_anomaly": "yes", "anomaly_type": "HIGH_AMOUNT"},
    {"is_ramadan": "off"},
    {"sender_id": "ACC_٠١٢٣٤"},
]


def test_each_rule_alone(spark):
    rows = text_rows(spark, *[change for _, change in BAD_ROWS])
    got = [row.violations for row in v.validate(rows).collect()]
    assert got == [[rule] for rule, _ in BAD_ROWS]


def test_type_and_positive_amount_imply_others(spark):
    rows = text_rows(spark, {"amount": "0"}, {"amount": "-5.00"}, {"transaction_type": "GIFT"})
    got = [row.violations for row in v.validate(rows).collect()]
    assert got == [["AMOUNT_POS", "FEES_GT_AMOUNT"], ["AMOUNT_POS", "FEES_GT_AMOUNT"], ["TYPE_ENUM"]]


def test_every_rule_has_a_bad_row(spark):
    covered = {rule for rule, _ in BAD_ROWS} | {"AMOUNT_POS", "TYPE_ENUM"}
    assert covered == set(v.rules({name: "string" for name in contract.COLUMNS}))


def test_valid_rows(spark):
    rows = text_rows(spark, *GOOD_ROWS)
    assert [row.violations for row in v.validate(rows).collect()] == [[]] * len(GOOD_ROWS)


def test_counts_agree_with_rows(spark):
    rows = text_rows(spark, *[change for _, change in BAD_ROWS], *GOOD_ROWS)
    report = v.row_validation(rows).first()
    assert (report.valid_count, report.invalid_count, report.is_valid) == (len(GOOD_ROWS), len(BAD_ROWS), False)
    counted = {row.rule: row.bad_rows for row in v.violations_by_rule(rows).collect()}
    expected = {rule: sum(other == rule for other, _ in BAD_ROWS) for rule in counted}
    assert counted == expected
    samples = v.failing_samples(rows, order=("timestamp", "sender_id")).collect()
    assert len(samples) == 5


def test_typed_rows(spark):
    rows = typed_rows(spark, {}, {"amount": 600000}, {"channel": None}, {"is_ramadan": None})
    assert [row.violations for row in v.validate(rows).collect()] == [
        [], ["AMOUNT_MAX"], ["CHANNEL_ENUM"], ["RAMADAN_BOOL"],
    ]
    naive = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert v.validate(naive).first().violations == ["TS_NO_TZ"]


def test_missing_column_and_null_cell_differ(spark):
    rows = text_rows(spark, {})
    assert v.row_validation(rows.drop("currency", "status", "fees", "transaction_id")).first().is_valid
    assert v.validate(text_rows(spark, {"currency": None})).first().violations == ["CURRENCY_ENUM"]
    assert "TYPE_ENUM" in v.validate(rows.drop("transaction_type")).first().violations


def test_column_check(spark):
    rows = text_rows(spark, {}, {"channel": None}).drop("fees").withColumn("note", F.lit("x"))
    assert v.missing_columns(rows) == ["fees"]
    assert v.extra_columns(rows) == ["note"]
    got = {row.column_name: (row.state, row.filled_cells) for row in v.column_check(rows).collect()}
    assert got["fees"] == ("MISSING", 0)
    assert got["note"] == ("EXTRA", 2)
    assert got["channel"] == ("REQUIRED", 1)
    assert len(got) == 19


def test_additional_rules(spark):
    rows = text_rows(spark, {}, {"channel": "APP"})
    extra = {"NO_APP": F.col("channel") == "APP"}
    assert [row.violations for row in v.validate(rows, extra).collect()] == [[], ["NO_APP"]]
    assert {row.rule: row.bad_rows for row in v.violations_by_rule(rows, extra).collect()}["NO_APP"] == 1
    with pytest.raises(ValueError):
        v.validate(rows, {"A|B": F.lit(True)})


def test_canonical_keeps_rows(spark):
    rows = v.canonical(text_rows(spark, {"timestamp": "bad", "amount": "x", "is_anomaly": "on"}))
    assert rows.schema.simpleString() == contract.CANONICAL_SCHEMA.simpleString()
    row = rows.first()
    assert (row.timestamp, row.amount, row.is_anomaly, row.is_ramadan) == (None, None, True, True)


def test_routes(spark, tmp_path):
    rows = text_rows(spark, {}, {"channel": "WEB"})
    path = v.write_routes(rows, str(tmp_path / "routes"))
    read = spark.read.parquet(path)
    assert {row.route: row.violations for row in read.collect()} == {"good": [], "quarantine": ["CHANNEL_ENUM"]}


def test_duplicates_and_season_flag(spark):
    rows = typed_rows(spark, {"transaction_id": "A"}, {"transaction_id": "A"}, {"is_ramadan": True})
    assert [tuple(row) for row in v.duplicate_ids(rows).collect()] == [("A", 2)]
    assert v.season_flag_mismatches(rows).first().transaction_id == "T0002"


def test_scale_is_judged_on_the_whole_text(spark):
    cells = {"1.0000000000000000001": True, "1.10": False, "1.100000": False, "1.001": True, "2e1": False, "x": False}
    rows = text_rows(spark, *[{"amount": cell, "fees": "0"} for cell in cells])
    found = [("AMOUNT_SCALE" in row.violations) for row in v.validate(rows).collect()]
    assert found == list(cells.values())
