from __future__ import annotations

import json

import pytest

from conftest import VALID_TEXT, found, text_rows, typed_rows
from walletlens import contract
from walletlens.operators import validation as v
from walletlens.sources import files
from walletlens.sources.event_log import transactions_from_events
from walletlens.sources.work import new_folder, settle

GOLDEN = [
    VALID_TEXT,
    {
        **VALID_TEXT,
        "transaction_id": "550e8400-e29b-41d4-a716-44665440002",
        "timestamp": "2026-04-03T10:30:00+00:00",
        "sender_id": "ACC_00003",
        "receiver_id": "ACC_00004",
        "amount": "3200.00",
        "transaction_type": "BILL_PAY",
        "channel": "APP",
        "operator": "Sedad",
        "sender_wilaya": "Nouakchott-Sud",
        "receiver_wilaya": "Dakhlet Nouadhibou",
        "fees": "0.00",
        "is_ramadan": "false",
        "bill_provider": "SOMELEC",
    },
    {
        **VALID_TEXT,
        "transaction_id": "550e8400-e29b-41d4-a716-44665440003",
        "timestamp": "2026-06-14T12:45:00+00:00",
        "sender_id": "ACC_00005",
        "receiver_id": "ACC_00006",
        "amount": "250000.00",
        "channel": "AGENT",
        "operator": "Masrvi",
        "sender_wilaya": "Trarza",
        "receiver_wilaya": "Tiris Zemmour",
        "fees": "2500.00",
        "is_ramadan": "false",
        "is_anomaly": "true",
        "anomaly_type": "HIGH_AMOUNT",
    },
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def csv_text():
    lines = [",".join(contract.COLUMNS)]
    lines += [",".join("" if row[name] is None else row[name] for name in contract.COLUMNS) for row in GOLDEN]
    return "\n".join(lines) + "\n"


def json_rows(absent):
    rows = []
    for row in GOLDEN:
        flags = {name: row[name] == "true" for name in ("is_ramadan", "is_anomaly")}
        rows.append({**{k: absent if x is None else x for k, x in row.items()}, **flags})
    return rows


def test_every_layout_reads_the_same(spark, tmp_path):
    csv = files.read_transactions(spark, write(tmp_path / "a.CSV", csv_text()))
    array = write(tmp_path / "array.json", json.dumps(json_rows(None), indent=2))
    blank = write(tmp_path / "blank.json", json.dumps(json_rows(""), indent=2))
    lines = write(tmp_path / "lines.json", "\n".join(json.dumps(row) for row in json_rows(None)))
    text_parquet = str(tmp_path / "text.parquet")
    files.canonical_text(csv).write.parquet(text_parquet)
    tables = [
        csv,
        files.read_transactions(spark, array, json_array=True),
        files.read_transactions(spark, blank, json_array=True),
        files.read_transactions(spark, lines),
        files.read_transactions(spark, lines, columns=contract.COLUMNS),
        files.read_transactions(spark, text_parquet),
    ]
    expected = found(v.canonical(csv), *contract.COLUMNS)
    assert len(expected) == 3
    for table in tables:
        assert v.row_validation(table).first().is_valid
        assert found(v.canonical(table), *contract.COLUMNS) == expected


def test_round_trips(spark, tmp_path):
    rows = typed_rows(spark, {"operator": 'a "quoted", nameé'}, {"bill_provider": None, "channel": None})
    expected = found(rows, *contract.COLUMNS)
    for extension in (".csv", ".json", ".parquet"):
        path = str(tmp_path / "sub" / f"out{extension}")
        assert files.write_transactions(rows, path) == path
        assert found(v.canonical(files.read_transactions(spark, path)), *contract.COLUMNS) == expected


def test_text_is_not_changed(spark, tmp_path):
    cells = ["  ACC_00001 ", "ACC_00001\n", "a\r\nb", 'say "x", y', "\t", "é"]
    rows = text_rows(spark, *[{"sender_id": cell} for cell in cells])
    for extension in (".csv", ".json"):
        path = files.write_transactions(rows, str(tmp_path / f"cells{extension}"), multi_line=True)
        again = files.read_transactions(spark, path, multi_line=True, columns=contract.COLUMNS)
        assert sorted(row.sender_id for row in again.select("sender_id").collect()) == sorted(cells)
    padded = rows.where("sender_id like '  %'")
    path = files.write_transactions(padded, str(tmp_path / "padded.csv"))
    assert files.read_transactions(spark, path).first().sender_id == "  ACC_00001 "
    with pytest.raises(Exception, match="multi_line"):
        files.write_transactions(rows, str(tmp_path / "broken.csv"))


def test_headers_in_another_order_are_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", "a,b\n1,2\n")
    write(tmp_path / "b.csv", "b,a\n3,4\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "*.csv")).collect()


def test_arrays_are_found(spark, tmp_path):
    path = write(tmp_path / "array.json", "\n " + json.dumps(json_rows(None), indent=2))
    assert files.read_transactions(spark, path).count() == len(GOLDEN)
    assert files.read_transactions(spark, path, columns=contract.COLUMNS).count() == len(GOLDEN)
    with pytest.raises(Exception):
        files.read_transactions(spark, path, json_array=False, columns=contract.COLUMNS).collect()


def test_flags_are_json_booleans(spark, tmp_path):
    path = files.write_transactions(typed_rows(spark, {}), str(tmp_path / "flags.json"))
    row = json.loads(spark.read.text(path).first()[0])
    assert (row["is_ramadan"], row["is_anomaly"], row["amount"]) == (False, False, "1000.00")


def test_accounts_are_not_merged(spark):
    columns = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.createDataFrame([(n, None, user, "click", 1.0, "") for n, user in enumerate((7, 12345, 123450, 123459))], columns)
    senders = sorted(row.sender_id for row in transactions_from_events(events).collect())
    assert senders == ["ACC_00007", "ACC_12345", "ACC_123450", "ACC_123459"]


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_transactions(spark, str(tmp_path / "a.txt"))
    with pytest.raises(ValueError):
        files.write_transactions(typed_rows(spark, {}), str(tmp_path / "a.xml"))
    assert files.format_of("folder/*", "PARQUET") == "parquet"
    with pytest.raises(Exception):
        files.read_transactions(spark, str(tmp_path / "none.parquet"))


def test_text_projection_fills_missing_columns(spark):
    text = files.canonical_text(text_rows(spark, {}).drop("fees"))
    assert text.columns == contract.COLUMNS
    assert (text.first().fees, text.first().bill_provider) == ("", "")


def test_settled_table(spark):
    rows = typed_rows(spark, {}, {"channel": None})
    again = settle(rows, "test")
    assert found(again, *contract.COLUMNS) == found(rows, *contract.COLUMNS)
    assert new_folder(spark, "a") != new_folder(spark, "a")
    assert settle(rows.filter("false"), "empty").count() == 0
