"""Readers, writers, intermediate tables and small dimension tables."""

from walletlens.sources.files import (
    canonical_text,
    format_of,
    read_csv,
    read_json,
    read_parquet,
    read_transactions,
    write_csv,
    write_json,
    write_parquet,
    write_transactions,
)
from walletlens.sources.work import new_folder, settle

__all__ = [
    "canonical_text",
    "format_of",
    "new_folder",
    "read_csv",
    "read_json",
    "read_parquet",
    "read_transactions",
    "settle",
    "write_csv",
    "write_json",
    "write_parquet",
    "write_transactions",
]
