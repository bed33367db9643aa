"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from conftest import SMALL
from walletlens.checks.compare import compare

import __spark_entry__ as entry_module


def test_entry_and_keys(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["metric", "value", "n"] and df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_results_equal_sql(spark):
    verdicts = compare(spark, SMALL)
    wrong = {name: verdict for name, verdict in verdicts.items() if not verdict.startswith(("ok", "rows-only"))}
    assert wrong == {}
