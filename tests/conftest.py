from __future__ import annotations

import os
import sys
from datetime import datetime, timezone
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from walletlens import contract  # noqa: E402
from walletlens.plans.session import local_session, prepare_stream  # noqa: E402

SMALL = "/root/testdata/sf0.001"

# A valid row; tests change single fields of it.
VALID_TEXT = {
    "transaction_id": "550e8400-e29b-41d4-a716-44665440001",
    "timestamp": "2026-02-20T21:15:00+00:00",
    "sender_id": "ACC_00001",
    "receiver_id": "ACC_00002",
    "amount": "15000.00",
    "currency": "MRU",
    "transaction_type": "TRANSFER",
    "channel": "USSD",
    "operator": "Bankily",
    "sender_wilaya": "Nouakchott-Ouest",
    "receiver_wilaya": "Nouakchott-Nord",
    "status": "SUCCESS",
    "fees": "150.00",
    "is_ramadan": "true",
    "bill_provider": None,
    "origin_country": None,
    "is_anomaly": "false",
    "anomaly_type": "NONE",
}


@pytest.fixture(scope="session")
def spark():
    return prepare_stream(local_session(8, "walletlens-tests"))


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def text_rows(spark, *changes: dict):
    """Text rows, each the valid row with some fields changed."""
    rows = [tuple({**VALID_TEXT, **change}[name] for name in contract.COLUMNS) for change in changes]
    return spark.createDataFrame(rows, contract.RAW_SCHEMA)


def typed_rows(spark, *changes: dict):
    """Typed rows; ids are numbered unless given."""
    base = {
        **VALID_TEXT,
        "timestamp": utc("2026-04-10T12:00:00"),
        "amount": Decimal("1000.00"),
        "fees": Decimal("10.00"),
        "is_ramadan": False,
        "is_anomaly": False,
    }
    rows = []
    for number, change in enumerate(changes):
        row = {**base, "transaction_id": f"T{number:04d}", **change}
        for name in ("amount", "fees"):
            row[name] = None if row[name] is None else Decimal(str(row[name]))
        rows.append(tuple(row[name] for name in contract.COLUMNS))
    return spark.createDataFrame(rows, contract.CANONICAL_SCHEMA)


def found(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
