"""Transactions in CSV, JSON and Parquet."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from walletlens import contract
from walletlens.sources.json_arrays import read_json_array

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def format_of(path: str, format: str | None = None) -> str:
    """Format by name or by the extension in any case; folders and globs need the name."""
    chosen = (format or FORMATS.get(os.path.splitext(path)[1].lower(), "")).lower()
    if chosen not in FORMATS.values():
        raise ValueError(f"not csv, json or parquet: {path}")
    return chosen


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV; every cell stays text and extra columns are kept.

    ``multi_line`` is for cells with line breaks; such a file cannot be split. Files of one read
    must have the same header in the same order; others are an error, not swapped columns.
    """
    options = {"header": True, "escape": '"', "encoding": "UTF-8", "inferSchema": False, "enforceSchema": False}
    return spark.read.options(**options).option("multiLine", multi_line).csv(path)


def read_json(
    spark: SparkSession, path: str, array: bool | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """One object per line, or with ``array`` one array per file; every value as its text.

    Without ``array`` the first line that is not blank decides. A line that is no object is an
    error of the reader.

    Without ``columns`` Spark reads all data once more to find the columns. Large sources
    should name them; a named column that no object has is then null, not missing. A file
    with an array is then read by many tasks; without ``columns`` it is one task.
    """
    if array is None:
        first = spark.read.text(path).where(F.col("value").rlike(r"\S")).first()
        array = first is not None and first[0].lstrip("\ufeff \t").startswith("[")
    if array and columns is not None:
        return read_json_array(spark, path, columns)
    reader = spark.read.option("multiLine", array).option("mode", "FAILFAST")
    if columns is None:
        return reader.option("primitivesAsString", True).json(path)
    return reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in columns])).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_transactions(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    json_array: bool | None = None,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read by format. A missing path is an error of the reader.

    ``multi_line`` is for CSV cells with line breaks; JSON arrays are found by their first line.
    """
    chosen = format_of(path, format)
    if chosen == "csv":
        return read_csv(spark, path, multi_line)
    if chosen == "json":
        return read_json(spark, path, json_array, columns)
    return read_parquet(spark, path)


def canonical_text(df: DataFrame) -> DataFrame:
    """The 18 columns in order as text, for text sinks: a null or a missing column is blank."""
    def cell(name: str):
        if name not in df.columns:
            return F.lit("").alias(name)
        column = F.col(name)
        if dict(df.dtypes)[name] == "timestamp":
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return F.coalesce(column.cast("string"), F.lit("")).alias(name)

    return df.select(*[cell(name) for name in contract.COLUMNS])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", multi_line: bool = False) -> str:
    """Header CSV with every cell as it is, blanks at its ends too.

    A cell with a line break is an error unless ``multi_line``; the table must then be read so, too.
    """
    options = {
        "header": True, "escape": '"', "encoding": "UTF-8", "emptyValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    rows = canonical_text(df)
    if not multi_line:
        # One test for a row: all its cells in one text.
        broken = F.raise_error(F.lit("a cell has a line break; write and read it with multi_line"))
        row = F.concat_ws("", *contract.COLUMNS)
        first = contract.COLUMNS[0]
        checked = F.when(row.contains("\n") | row.contains("\r"), broken.cast("string")).otherwise(F.col(first))
        rows = rows.withColumn(first, checked)
    rows.write.mode(mode).options(**options).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One object per line; text outside ASCII is written as it is.

    Boolean columns are written as JSON booleans, all others as text.
    """
    rows = canonical_text(df)
    flags = [name for name, kind in df.dtypes if kind == "boolean" and name in contract.COLUMNS]
    rows = rows.withColumns({name: F.col(name).try_cast("boolean") for name in flags}) if flags else rows
    rows.write.mode(mode).option("encoding", "UTF-8").json(path)
    return path


def write_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", by_date: bool = False
) -> str:
    """Typed Parquet. ``by_date`` adds a ``tx_date`` folder per day for partition pruning.

    The rebalance hint brings the rows of a day together, splits a day that is too large
    for one task, and joins days that are small, so no day is one task and none becomes
    one file per task.
    """
    rows = df.select(*contract.COLUMNS)
    if not by_date:
        rows.write.mode(mode).parquet(path)
        return path
    dated = rows.withColumn("tx_date", F.to_date("timestamp"))
    dated.hint("rebalance", "tx_date").write.mode(mode).partitionBy("tx_date").parquet(path)
    return path


def write_transactions(
    df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", multi_line: bool = False
) -> str:
    """Write by format or extension; Spark makes the folders on the way."""
    chosen = format_of(path, format)
    if chosen == "csv":
        return write_csv(df, path, mode, multi_line)
    return write_json(df, path, mode) if chosen == "json" else write_parquet(df, path, mode)
