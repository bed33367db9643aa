"""Row contract: one predicate per rule, evaluated on all executors without Python code."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from walletlens import contract
from walletlens.functions import Season, DEFAULT_SEASONS, blank_to_null, in_season, utc_timestamp
from walletlens.functions.calendar import TIMESTAMP_PATTERN

# Wide enough to see the decimals that the narrow type would round away.
_WIDE = "decimal(38,18)"

_OFFSET = r"([Zz]|[+-]\d{2}(:?\d{2})?)\s*\z"
_ZERO_OFFSET = r"([Zz]|[+-]00(:?00)?)\s*\z"

# More than two decimals, zeros at the end aside.
_FINE = r"\.\d{2}\d*[1-9]0*\s*\z"

_SEPARATOR = "|"

_ENUM_RULES = {
    "currency": ("CURRENCY_ENUM", contract.CURRENCIES),
    "transaction_type": ("TYPE_ENUM", contract.TRANSACTION_TYPES),
    "channel": ("CHANNEL_ENUM", contract.CHANNELS),
    "operator": ("OPERATOR_ENUM", contract.OPERATORS),
    "status": ("STATUS_ENUM", contract.STATUSES),
    "sender_wilaya": ("SENDER_WILAYA_ENUM", contract.REGIONS),
    "receiver_wilaya": ("RECEIVER_WILAYA_ENUM", contract.REGIONS),
    "anomaly_type": ("ANOMALY_TYPE_ENUM", contract.ANOMALY_TYPES),
}


# ---------------------------------------------------------------- columns


def missing_columns(df: DataFrame) -> list[str]:
    return [name for name in contract.COLUMNS if name not in df.columns]


def extra_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in contract.COLUMNS]


def column_states(df: DataFrame) -> dict[str, str]:
    """REQUIRED, MISSING or EXTRA for each expected or additional column, without reading data."""
    missing = set(missing_columns(df))
    state = {name: "MISSING" if name in missing else "REQUIRED" for name in contract.COLUMNS}
    return state | {name: "EXTRA" for name in extra_columns(df)}


def column_check(df: DataFrame) -> DataFrame:
    """One row per expected or additional column: its state and the number of filled cells.

    The table conforms when no row has the state MISSING; additional columns do no harm. For the
    states alone see ``column_states``.
    """
    state = {name: kind for name, kind in column_states(df).items() if kind != "REQUIRED"}
    counts = [
        (F.lit(0).cast("bigint") if state.get(name) == "MISSING" else F.count(F.col(f"`{name}`"))).alias(name)
        for name in contract.COLUMNS + extra_columns(df)
    ]
    names = F.create_map(*[F.lit(part) for pair in state.items() for part in pair]) if state else None
    filled = df.agg(*counts, F.count(F.lit(1)).alias("__rows"))
    columns = [name for name in filled.columns if name != "__rows"]
    rows = filled.unpivot("__rows", [f"`{name}`" for name in columns], "column_name", "filled_cells")
    found = F.try_element_at(names, F.col("column_name")) if state else F.lit(None).cast("string")
    return rows.select(
        "column_name",
        F.coalesce(found, F.lit("REQUIRED")).alias("state"),
        "filled_cells",
        F.col("__rows").alias("row_count"),
    )


# ---------------------------------------------------------------- cells


def normalized(df: DataFrame) -> DataFrame:
    """Blank text and NaN become null; other cells stay as they are."""
    def cell(name: str, kind: str) -> Column:
        column = F.col(name)
        if kind == "string":
            column = blank_to_null(column)
        elif kind in ("double", "float"):
            column = F.when(~F.isnan(column), column)
        return column.alias(name)

    types = dict(df.dtypes)
    return df.select(*[cell(name, types[name]) if name in contract.COLUMNS else F.col(f"`{name}`") for name in df.columns])


def with_defaults(df: DataFrame) -> DataFrame:
    """Add the columns that ``df`` does not have at all.

    Columns without a default come in as null and break their rule. A missing id becomes a
    random UUID, which differs between runs: write the result before it is used twice.
    """
    added = {}
    for name in missing_columns(df):
        if name == "transaction_id":
            added[name] = F.uuid()
        else:
            added[name] = F.lit(contract.COLUMN_DEFAULTS.get(name)).cast("string")
    return df.withColumns(added) if added else df


def payload(df: DataFrame) -> DataFrame:
    """The 18 columns in order: blanks as null, missing columns by default, others left out."""
    return with_defaults(normalized(df)).select(*contract.COLUMNS)


def canonical(df: DataFrame, raw: Sequence[str] = ()) -> DataFrame:
    """Typed record; a cell that cannot be read becomes null and its row is kept.

    Columns in ``raw`` keep their cells as they are.
    """
    rows = payload(df)
    kinds = dict(rows.dtypes)

    def cell(field) -> Column:
        column, kind = F.col(field.name), kinds[field.name]
        if field.name in raw:
            return column
        if field.name == "timestamp":
            column = utc_timestamp(column) if kind == "string" else column.cast("timestamp")
        elif field.name in ("amount", "fees"):
            column = column.try_cast(_WIDE).try_cast(field.dataType)
        elif field.name in ("is_ramadan", "is_anomaly") and kind != "boolean":
            column = _boolean(column)
        else:
            column = column.cast(field.dataType)
        return column.alias(field.name)

    return rows.select(*[cell(field) for field in contract.CANONICAL_SCHEMA.fields])


def _boolean(column: Column) -> Column:
    word = F.lower(column.cast("string"))
    return F.when(word.isin(*contract.TRUE_WORDS), True).when(word.isin(*contract.FALSE_WORDS), False)


def _money(column: Column, kind: str) -> tuple[Column, Column]:
    """The amount, and whether it has more than two decimals; a money column cannot have."""
    if kind == contract.MONEY.simpleString():
        return column, F.lit(False)
    wide = column.try_cast(_WIDE)
    finer = wide != F.round(wide, 2)
    # The type holds 18 places; the text is judged to its end.
    return wide, finer | (wide.isNotNull() & column.rlike(_FINE)) if kind == "string" else finer


# ---------------------------------------------------------------- rules


def rules(kinds: Mapping[str, str]) -> dict[str, Column]:
    """Predicate of each rule, true for a row that breaks it.

    ``kinds`` gives the type of each column: time zone and scale are judged on the text
    where the source has text, before any cast could hide them.
    """
    column = {name: F.col(name) for name in contract.COLUMNS}
    found: dict[str, Column] = {}

    stamp = column["timestamp"]
    found["TS_NULL"] = stamp.isNull()
    if kinds["timestamp"] == "string":
        readable = stamp.rlike(TIMESTAMP_PATTERN) & utc_timestamp(stamp).isNotNull()
        found["TS_PARSE"] = stamp.isNotNull() & ~readable
        found["TS_NO_TZ"] = readable & ~stamp.rlike(r":\d{2}([.,]\d+)?\s*" + _OFFSET)
        found["TS_NOT_UTC"] = readable & stamp.rlike(r":\d{2}([.,]\d+)?\s*" + _OFFSET) & ~stamp.rlike(_ZERO_OFFSET)
    elif kinds["timestamp"] == "timestamp_ntz":
        found["TS_NO_TZ"] = stamp.isNotNull()

    found["ID_NULL"] = column["transaction_id"].isNull()
    for name, rule in (("sender_id", "SENDER_FMT"), ("receiver_id", "RECEIVER_FMT")):
        found[rule] = ~F.coalesce(column[name].rlike(contract.ACCOUNT_PATTERN), F.lit(False))

    amount, amount_scale = _money(column["amount"], kinds["amount"])
    fees, fees_scale = _money(column["fees"], kinds["fees"])
    found["AMOUNT_NULL"] = amount.isNull()
    found["AMOUNT_POS"] = amount <= 0
    found["AMOUNT_MAX"] = amount > F.lit(contract.MAX_AMOUNT).cast("decimal(18,2)")
    found["AMOUNT_SCALE"] = amount_scale
    found["FEES_NULL"] = fees.isNull()
    found["FEES_NEG"] = fees < 0
    found["FEES_SCALE"] = fees_scale

    for name, (rule, allowed) in _ENUM_RULES.items():
        found[rule] = ~F.coalesce(column[name].isin(*allowed), F.lit(False))

    for name, rule in (("is_ramadan", "RAMADAN_BOOL"), ("is_anomaly", "ANOMALY_BOOL")):
        found[rule] = column[name].isNull() if kinds[name] == "boolean" else _boolean(column[name]).isNull()
    is_anomaly = column["is_anomaly"] if kinds["is_anomaly"] == "boolean" else _boolean(column["is_anomaly"])

    provider = column["bill_provider"]
    country = column["origin_country"]
    kind = column["transaction_type"]
    found["PROVIDER_ENUM"] = provider.isNotNull() & ~provider.isin(*contract.BILL_PROVIDERS)
    found["ORIGIN_FMT"] = country.isNotNull() & ~country.rlike(contract.COUNTRY_PATTERN)
    found["SELF_TRANSFER"] = column["sender_id"] == column["receiver_id"]
    found["FEES_GT_AMOUNT"] = fees > amount
    found["BILL_PROVIDER_MISSING"] = (kind == "BILL_PAY") & provider.isNull()
    found["BILL_PROVIDER_UNEXPECTED"] = (kind != "BILL_PAY") & provider.isNotNull()
    found["ORIGIN_UNEXPECTED"] = (kind != "CASH_IN") & country.isNotNull()
    found["ANOMALY_TYPE_MISSING"] = is_anomaly & (column["anomaly_type"] == "NONE")
    found["ANOMALY_TYPE_UNEXPECTED"] = ~is_anomaly & (column["anomaly_type"] != "NONE")
    return found


def _rules_of(rows: DataFrame, extra_rules: Mapping[str, Column]) -> dict[str, Column]:
    known = rules(dict(rows.dtypes)) | dict(extra_rules)
    if any(_SEPARATOR in name for name in known):
        raise ValueError(f"a rule name may not hold {_SEPARATOR!r}")
    return known


def validate(df: DataFrame, extra_rules: Mapping[str, Column] = {}) -> DataFrame:
    """The record with ``violations``, the names of all rules that the row breaks.

    Works on a batch and on a stream. The names are first joined to one text, because
    Spark compiles that form; the array is cut from it only for rows that break a rule.
    """
    rows = payload(df)
    known = _rules_of(rows, extra_rules)
    broken = F.concat_ws(_SEPARATOR, *[F.when(bad, F.lit(name)) for name, bad in known.items()])
    return rows.withColumn("__broken", broken).select(
        *contract.COLUMNS,
        F.when(F.col("__broken") == "", F.array().cast("array<string>"))
        .otherwise(F.split("__broken", r"\|"))
        .alias("violations"),
    )


def observed(df: DataFrame, extra_rules: Mapping[str, Column] = {}) -> DataFrame:
    """``validate`` with an observation of rows, failing rows and empty cells.

    A query listener receives the three numbers. The observation also keeps later filters
    and counts behind the check: merged into it, they would evaluate every rule a second
    time, or outgrow the methods that the JVM compiles, which costs four times the run
    time. The count of empty cells uses every column, and Spark moves the check into a
    method of its own only when all columns are used again behind it.
    """
    empty = sum((F.col(name).isNull().cast("int") for name in contract.COLUMNS), F.lit(0))
    return validate(df, extra_rules).observe(
        f"row-check-{uuid.uuid4().hex}",
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size("violations") > 0).alias("failing_rows"),
        F.sum(empty).alias("empty_cells"),
    )


def failing_rows(
    df: DataFrame, extra_rules: Mapping[str, Column] = {}, where: Column | None = None
) -> DataFrame:
    """Rows that break a rule, with the names of the rules.

    A filter on the result stays behind the check. ``where`` is a filter on the columns of ``df``
    that goes before it and reaches the scan.
    """
    rows = df if where is None else df.filter(where)
    return observed(rows, extra_rules).filter(F.size("violations") > 0)


def row_validation(df: DataFrame, extra_rules: Mapping[str, Column] = {}) -> DataFrame:
    """One row: valid_count, invalid_count, is_valid."""
    counted = observed(df, extra_rules).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("violations") == 0).alias("valid_count")
    )
    return counted.select(
        "valid_count",
        (F.col("n") - F.col("valid_count")).alias("invalid_count"),
        (F.col("n") == F.col("valid_count")).alias("is_valid"),
    )


def violations_by_rule(df: DataFrame, extra_rules: Mapping[str, Column] = {}) -> DataFrame:
    """Rows that break each rule, also for rules that no row breaks; one scan, no row shuffle."""
    names = list(_rules_of(payload(df), extra_rules))
    counts = [F.count_if(F.array_contains("violations", name)).alias(name) for name in names]
    return observed(df, extra_rules).agg(*counts).unpivot([], names, "rule", "bad_rows")


def failing_samples(
    df: DataFrame, max_errors: int = 5, order: Sequence[str] = ("transaction_id", "timestamp")
) -> DataFrame:
    """The first failing rows in a stated order; a table has no row number of its own.

    For Parquet files the position in the file is ``_metadata.file_path`` and
    ``_metadata.row_index``; pass them as additional columns of ``order``.
    """
    text = F.array_join(F.array_sort("violations"), ",").alias("reasons")
    failing = failing_rows(df).select(*order, text)
    return failing.orderBy(*[F.asc_nulls_last(name) for name in order], "reasons").limit(max_errors)


def with_route(df: DataFrame, extra_rules: Mapping[str, Column] = {}) -> DataFrame:
    """Validated rows with ``route`` good or quarantine."""
    checked = validate(df, extra_rules)
    return checked.withColumn("route", F.when(F.size("violations") == 0, "good").otherwise("quarantine"))


def write_routes(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write good and bad rows to ``route=good`` and ``route=quarantine`` in one pass."""
    with_route(df).write.mode(mode).partitionBy("route").parquet(path)
    return path


# ---------------------------------------------------------------- whole-table checks


def unreadable_timestamps(df: DataFrame) -> DataFrame:
    """One row: rows whose time can be read and rows whose time cannot."""
    stamp = canonical(df).select("timestamp")
    return stamp.agg(
        F.count("timestamp").alias("readable_rows"),
        F.count_if(F.col("timestamp").isNull()).alias("unreadable_rows"),
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids on more than one row. The count is combined before the shuffle."""
    return df.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def season_flag_mismatches(tx: DataFrame, seasons: Sequence[Season] = DEFAULT_SEASONS) -> DataFrame:
    """Rows whose stored season flag differs from the flag of their date."""
    expected = in_season(F.col("timestamp"), seasons)
    return tx.select(
        "transaction_id", "timestamp", "is_ramadan", expected.alias("expected_flag")
    ).filter(~F.col("is_ramadan").eqNullSafe(F.col("expected_flag")))
