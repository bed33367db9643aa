"""Compares registered queries with their SQL: names, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

from walletlens.checks.oracles import all_oracles
from walletlens.checks.queries import all_queries
from walletlens.plans.session import local_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _plain(value):
    if isinstance(value, Decimal):
        return ("decimal", format(value, "f"))
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if hasattr(value, "isoformat"):
        return (type(value).__name__, value.isoformat())
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    return Counter(tuple(_plain(row[index]) for index in order) for row in rows)


def compare(spark, folder: str, names=()) -> dict[str, str]:
    """Verdict per query: ok, rows-only or the difference."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    oracles, verdicts = all_oracles(), {}
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = query(spark, folder)
            ours = _rows(df.columns, df.collect())
            if name not in oracles:
                verdicts[name] = f"rows-only {sum(ours.values())}"
            else:
                cursor = con.execute(oracles[name])
                columns = [column[0] for column in cursor.description]
                theirs = _rows(columns, cursor.fetchall())
                if sorted(columns) != sorted(df.columns):
                    verdicts[name] = f"COLUMNS {sorted(df.columns)} / {sorted(columns)}"
                elif ours != theirs:
                    verdicts[name] = (
                        f"VALUES {sum(ours.values())} / {sum(theirs.values())} rows; only here "
                        f"{list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
                    )
                else:
                    verdicts[name] = f"ok {sum(ours.values())}"
        except Exception as error:
            verdicts[name] = f"ERROR {str(error)[:600]}"
        print(f"{name:30s} {time.time() - started:6.2f}s {verdicts[name]}", flush=True)
    return verdicts


if __name__ == "__main__":
    session = local_session()
    result = compare(session, sys.argv[1], sys.argv[2:])
    bad = [name for name, verdict in result.items() if not verdict.startswith(("ok", "rows-only"))]
    print(f"{len(result) - len(bad)} of {len(result)} agree; not: {bad}")
