"""The registered queries in SQL over the given tables.

Every text starts from the same mapping of events to transactions.
"""

from __future__ import annotations

from walletlens import contract
from walletlens.sources import dimensions


def _list(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _pick(values, index: str) -> str:
    return f"([{_list(values)}])[({index}) + 1]"


_EVENTS = f"""
base AS (
  SELECT event_id AS i, user_id AS u, ts, event_type AS kind,
         CAST(value AS DECIMAL(18,2)) AS v,
         CASE WHEN event_id % 7 = 3 THEN 140 + event_id % 5
              ELSE (user_id * 7 + event_id % 11 + 1) % 150 END AS r
  FROM events
),
mapped AS (
  SELECT i, u,
    'EVT_' || CAST(CASE WHEN i % 400 = 399 THEN i - 1 ELSE i END AS VARCHAR) AS transaction_id,
    ts AS "timestamp",
    'ACC_' || lpad(CAST(u AS VARCHAR), CAST(greatest(5, length(CAST(u AS VARCHAR))) AS INTEGER), '0') AS sender_id,
    'ACC_' || lpad(CAST(r AS VARCHAR), CAST(greatest(5, length(CAST(r AS VARCHAR))) AS INTEGER), '0') AS receiver_id,
    CAST(CASE WHEN i % 977 = 0 THEN 600000 WHEN i % 7 = 3 THEN 500
              WHEN i % 97 = 0 THEN v * 2000 ELSE v * 100 END AS DECIMAL(18,2)) AS amount,
    CASE WHEN i % 501 = 0 THEN 'EUR' WHEN i % 25 = 0 THEN 'XOF' WHEN i % 25 = 1 THEN 'USD' ELSE 'MRU' END AS currency,
    CASE WHEN i % 10 = 0 THEN 'AIRTIME' WHEN kind = 'purchase' THEN 'MERCHANT' WHEN kind = 'click' THEN 'TRANSFER'
         WHEN kind = 'view' THEN 'BILL_PAY' WHEN kind = 'signup' THEN 'CASH_IN'
         WHEN kind = 'error' THEN 'CASH_OUT' END AS transaction_type,
    CASE WHEN i % 701 = 0 THEN NULL WHEN i % 20 < 14 THEN 'USSD' WHEN i % 20 < 19 THEN 'APP' ELSE 'AGENT' END AS channel,
    {_pick(contract.OPERATORS, 'u % 9')} AS operator,
    {_pick(contract.REGIONS, 'CASE WHEN i % 307 = 0 THEN (u + 1) % 15 ELSE u % 15 END')} AS sender_wilaya,
    {_pick(contract.REGIONS, 'CASE WHEN i % 89 = 0 THEN (r + 7) % 15 ELSE r % 15 END')} AS receiver_wilaya,
    CASE WHEN kind = 'error' AND i % 3 = 0 THEN 'FAILED' WHEN i % 50 = 7 THEN 'PENDING' ELSE 'SUCCESS' END AS status
  FROM base
),
tx_i AS (
  SELECT i, transaction_id, "timestamp", sender_id, receiver_id, amount, currency, transaction_type, channel,
    operator, sender_wilaya, receiver_wilaya, status,
    CAST(CASE WHEN i % 613 = 0 THEN amount * 2
              WHEN transaction_type IN ('AIRTIME', 'BILL_PAY') OR status = 'FAILED' THEN 0
              ELSE amount * CAST(0.01 AS DECIMAL(3,2)) END AS DECIMAL(18,2)) AS fees,
    CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' AS is_ramadan,
    CASE WHEN transaction_type = 'BILL_PAY' AND i % 211 <> 0
         THEN (['SOMELEC', 'SNDE', 'MAURITEL', 'CHINGUITEL'])[u % 4 + 1] END AS bill_provider,
    CASE WHEN transaction_type = 'CASH_IN' AND i % 5 = 1 THEN (['ES', 'US', 'FR', 'FR'])[u % 4 + 1] END AS origin_country,
    i % 97 = 0 OR i % 977 = 0 OR (status = 'FAILED' AND i % 6 = 0) OR i % 499 = 0 AS is_anomaly,
    CASE WHEN i % 97 = 0 OR i % 977 = 0 THEN 'HIGH_AMOUNT'
         WHEN status = 'FAILED' AND i % 6 = 0 THEN 'OPERATOR_OUTAGE' ELSE 'NONE' END AS anomaly_type
  FROM mapped
),
tx AS (SELECT * EXCLUDE (i) FROM tx_i)"""

_RAW = _EVENTS + """,
raw AS (
  SELECT
    CASE p WHEN 5 THEN NULL ELSE transaction_id END AS transaction_id,
    CASE WHEN p = 1 THEN stamp WHEN p = 2 THEN stamp || '+01:00' WHEN p = 3 THEN 'not a date' WHEN p = 4 THEN NULL
         WHEN p > 125 THEN stamp || 'Z' ELSE stamp || '+00:00' END AS "timestamp",
    CASE p WHEN 6 THEN 'ACC_0001' WHEN 7 THEN 'ACC_00001' || chr(10) WHEN 26 THEN '  ACC_00001 ' ELSE sender_id END AS sender_id,
    CASE p WHEN 8 THEN NULL ELSE receiver_id END AS receiver_id,
    CASE p WHEN 9 THEN 'abc' WHEN 10 THEN '-5.00' WHEN 11 THEN '1.005' ELSE CAST(amount AS VARCHAR) END AS amount,
    currency,
    CASE p WHEN 12 THEN 'GIFT' ELSE transaction_type END AS transaction_type,
    CASE p WHEN 13 THEN 'WEB' ELSE channel END AS channel,
    CASE p WHEN 14 THEN 'Nope' ELSE operator END AS operator,
    CASE p WHEN 15 THEN NULL ELSE sender_wilaya END AS sender_wilaya,
    CASE p WHEN 16 THEN 'Atlantis' ELSE receiver_wilaya END AS receiver_wilaya,
    CASE p WHEN 17 THEN 'DONE' ELSE status END AS status,
    CASE p WHEN 18 THEN '-1' WHEN 19 THEN '0.001' WHEN 20 THEN NULL ELSE CAST(fees AS VARCHAR) END AS fees,
    CASE p WHEN 21 THEN 'maybe' ELSE CAST(is_ramadan AS VARCHAR) END AS is_ramadan,
    CASE p WHEN 22 THEN 'ACME' ELSE bill_provider END AS bill_provider,
    CASE p WHEN 23 THEN 'fr' ELSE origin_country END AS origin_country,
    CASE p WHEN 24 THEN 'perhaps' ELSE CAST(is_anomaly AS VARCHAR) END AS is_anomaly,
    CASE p WHEN 25 THEN 'ODD' ELSE anomaly_type END AS anomaly_type
  FROM (SELECT *, i % 251 AS p, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM tx_i)
)"""

_STAMP_OK = r"""regexp_full_match("timestamp", '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+(Z|[+-]\d\d:\d\d)?')"""

_SHARED_RULES = {
    "ID_NULL": "transaction_id IS NULL",
    "SENDER_FMT": r"NOT coalesce(regexp_full_match(sender_id, 'ACC_\p{Nd}{5}'), false)",
    "RECEIVER_FMT": r"NOT coalesce(regexp_full_match(receiver_id, 'ACC_\p{Nd}{5}'), false)",
    "AMOUNT_NULL": "amt IS NULL",
    "AMOUNT_POS": "amt <= 0",
    "AMOUNT_MAX": "amt > 500000.00",
    "AMOUNT_SCALE": "amt <> round(amt, 2)",
    "FEES_NULL": "fee IS NULL",
    "FEES_NEG": "fee < 0",
    "FEES_SCALE": "fee <> round(fee, 2)",
    "CURRENCY_ENUM": f"currency IS NULL OR currency NOT IN ({_list(contract.CURRENCIES)})",
    "TYPE_ENUM": f"transaction_type IS NULL OR transaction_type NOT IN ({_list(contract.TRANSACTION_TYPES)})",
    "CHANNEL_ENUM": f"channel IS NULL OR channel NOT IN ({_list(contract.CHANNELS)})",
    "OPERATOR_ENUM": f"operator IS NULL OR operator NOT IN ({_list(contract.OPERATORS)})",
    "STATUS_ENUM": f"status IS NULL OR status NOT IN ({_list(contract.STATUSES)})",
    "SENDER_WILAYA_ENUM": f"sender_wilaya IS NULL OR sender_wilaya NOT IN ({_list(contract.REGIONS)})",
    "RECEIVER_WILAYA_ENUM": f"receiver_wilaya IS NULL OR receiver_wilaya NOT IN ({_list(contract.REGIONS)})",
    "ANOMALY_TYPE_ENUM": f"anomaly_type IS NULL OR anomaly_type NOT IN ({_list(contract.ANOMALY_TYPES)})",
    "RAMADAN_BOOL": "TRY_CAST(is_ramadan AS BOOLEAN) IS NULL",
    "ANOMALY_BOOL": "TRY_CAST(is_anomaly AS BOOLEAN) IS NULL",
    "PROVIDER_ENUM": f"bill_provider NOT IN ({_list(contract.BILL_PROVIDERS)})",
    "ORIGIN_FMT": "NOT regexp_full_match(origin_country, '[A-Z]{2}')",
    "SELF_TRANSFER": "sender_id = receiver_id",
    "FEES_GT_AMOUNT": "fee > amt",
    "BILL_PROVIDER_MISSING": "transaction_type = 'BILL_PAY' AND bill_provider IS NULL",
    "BILL_PROVIDER_UNEXPECTED": "transaction_type <> 'BILL_PAY' AND bill_provider IS NOT NULL",
    "ORIGIN_UNEXPECTED": "transaction_type <> 'CASH_IN' AND origin_country IS NOT NULL",
    "ANOMALY_TYPE_MISSING": "TRY_CAST(is_anomaly AS BOOLEAN) AND anomaly_type = 'NONE'",
    "ANOMALY_TYPE_UNEXPECTED": "NOT TRY_CAST(is_anomaly AS BOOLEAN) AND anomaly_type <> 'NONE'",
}
_TYPED_RULES = {"TS_NULL": '"timestamp" IS NULL'} | _SHARED_RULES
_TEXT_RULES = {
    "TS_NULL": '"timestamp" IS NULL',
    "TS_PARSE": f'"timestamp" IS NOT NULL AND NOT {_STAMP_OK}',
    "TS_NO_TZ": rf"""{_STAMP_OK} AND NOT regexp_matches("timestamp", '(Z|[+-]\d\d:\d\d)$')""",
    "TS_NOT_UTC": rf"""{_STAMP_OK} AND regexp_matches("timestamp", '[+-]\d\d:\d\d$') AND "timestamp" NOT LIKE '%+00:00'""",
} | _SHARED_RULES


def _checked(source: str, rules: dict[str, str]) -> str:
    flags = ",\n    ".join(f"coalesce({test}, false) AS {name}" for name, test in rules.items())
    bad = " OR ".join(rules)
    names = ", ".join(f"CASE WHEN {name} THEN '{name}' END" for name in sorted(rules))
    return f"""numbered AS (
  SELECT *, TRY_CAST(amount AS DECIMAL(38,10)) AS amt, TRY_CAST(fees AS DECIMAL(38,10)) AS fee FROM {source}
),
flagged AS (SELECT *, {flags} FROM numbered),
checked AS (SELECT *, {bad} AS bad, concat_ws(',', {names}) AS reasons FROM flagged)"""


def _row_validation(source: str, rules: dict[str, str]) -> str:
    return f""", {_checked(source, rules)}
SELECT count(*) FILTER (WHERE NOT bad) AS valid_count, count(*) FILTER (WHERE bad) AS invalid_count,
       count(*) FILTER (WHERE bad) = 0 AS is_valid FROM checked"""


def _by_rule(source: str, rules: dict[str, str]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {name}) AS bad_rows FROM checked" for name in rules
    )
    return f", {_checked(source, rules)} {counts}"


def _failing(source: str, rules: dict[str, str]) -> str:
    return f', {_checked(source, rules)} SELECT transaction_id, "timestamp", reasons FROM checked WHERE bad'


_COLUMNS = ", ".join(f'"{name}"' for name in contract.COLUMNS)


def _routes(source: str, rules: dict[str, str]) -> str:
    return f""", {_checked(source, rules)}
SELECT {_COLUMNS}, reasons AS violations, CASE WHEN bad THEN 'quarantine' ELSE 'good' END AS route FROM checked"""


def _percent(part: str, whole: str) -> str:
    return f"coalesce(round_even(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100, 2), 0.0)"


def _ratio(value: str, divisor: str) -> str:
    return f"coalesce(round_even(CAST({value} AS DOUBLE) / nullif(CAST({divisor} AS DOUBLE), 0), 2), 0.0)"


def _share(column: str, tail: str = "") -> str:
    return f"""SELECT {column} AS value, count(*) AS n, {_percent('count(*)', '(SELECT count(*) FROM tx)')} AS share
FROM tx GROUP BY ALL {tail}"""


_GEO = f"""
SELECT {_percent('count(*) FILTER (WHERE capital)', 'count(*)')} AS capital_percent,
       {_percent('count(*) FILTER (WHERE port)', 'count(*)')} AS port_percent"""
_GEO_FROM = f"""
FROM (SELECT sender_wilaya IN ({_list(contract.CAPITAL_REGIONS)}) AS capital,
             sender_wilaya = '{contract.PORT_REGION}' AS port FROM tx)"""
_GEO_PREFIX_FROM = f"""
FROM (SELECT starts_with(sender_wilaya, 'Nouakchott') AS capital,
             sender_wilaya = '{contract.PORT_REGION}' AS port FROM tx)"""
_GEO_SUMMARY = f"""SELECT capital_percent, port_percent,
  round_even(100.0::DOUBLE - capital_percent - port_percent, 2) AS other_percent FROM ({_GEO} {_GEO_FROM})"""

_DAILY = 'SELECT CAST("timestamp" AS DATE) AS tx_date, count(*) AS n FROM tx GROUP BY ALL'
_DAILY_SUMMARY = f"""SELECT count(*) AS days, {_ratio('sum(n)', 'count(*)')} AS mean_rows,
  min(n) AS min_rows, max(n) AS max_rows FROM ({_DAILY})"""


def _periods(inside: str, name: str) -> str:
    return f"""SELECT *, {_ratio(f'{name}_daily_avg', 'other_daily_avg')} AS {name}_multiplier FROM (
  SELECT CAST(coalesce(sum(n) FILTER (WHERE inside), 0) AS BIGINT) AS {name}_transactions,
         CAST(coalesce(sum(n) FILTER (WHERE NOT inside), 0) AS BIGINT) AS other_transactions,
         {_ratio('coalesce(sum(n) FILTER (WHERE inside), 0)', 'greatest(1, count(*) FILTER (WHERE inside))')} AS {name}_daily_avg,
         {_ratio('coalesce(sum(n) FILTER (WHERE NOT inside), 0)', 'greatest(1, count(*) FILTER (WHERE NOT inside))')} AS other_daily_avg
  FROM (SELECT n, {inside} AS inside FROM ({_DAILY})))"""


_SEASON = "tx_date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'"
_SALARY = "day(tx_date) BETWEEN 1 AND 5"
_IN_SEASON = "CAST(\"timestamp\" AS DATE) BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'"
_SALARY_DAY = 'day("timestamp") BETWEEN 1 AND 5'
_RURAL = f"coalesce(sender_wilaya IN ({_list(contract.RURAL_REGIONS)}), false)"
_WEEKEND = 'isodow("timestamp") IN (5, 6, 7)'

_METRICS = {
    "channel": "channel",
    "sender_wilaya": "sender_wilaya",
    "transaction_type": "transaction_type",
    "anomaly_type": "anomaly_type",
    "is_anomaly": "CAST(is_anomaly AS VARCHAR)",
    "tx_date": "CAST(CAST(\"timestamp\" AS DATE) AS VARCHAR)",
    "rows": "'all'",
}
_PROFILE = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, {value} AS value, count(*) AS n FROM tx GROUP BY ALL" for name, value in _METRICS.items()
)

_BASIC = f"""
SELECT 'rows' AS section, CAST(NULL AS VARCHAR) AS value, CAST(count(*) AS DOUBLE) AS metric FROM tx
UNION ALL SELECT 'channels_percent', value, share FROM ({_share('channel')})
UNION ALL SELECT 'types_percent', value, share FROM ({_share('transaction_type')})
UNION ALL SELECT 'capital_percent', NULL, capital_percent FROM ({_GEO} {_GEO_PREFIX_FROM})
UNION ALL SELECT 'port_percent', NULL, port_percent FROM ({_GEO} {_GEO_PREFIX_FROM})
UNION ALL SELECT 'top_regions_percent', value, share FROM ({_share('sender_wilaya', 'ORDER BY n DESC, value LIMIT 8')})
UNION ALL SELECT 'anomaly_percent', NULL, {_percent('count(*) FILTER (WHERE is_anomaly)', 'count(*)')} FROM tx
UNION ALL SELECT 'anomaly_types_count', anomaly_type, CAST(count(*) AS DOUBLE) FROM tx GROUP BY ALL"""



def _report_rows(section: str, table: str, key: str | None, numbers: str, texts: str = "") -> str:
    """Rows of (section, key, metric, value, text) of one table of the report."""
    parts = [(name, f"CAST({name} AS DOUBLE)", "CAST(NULL AS VARCHAR)") for name in numbers.split()]
    parts += [(name, "CAST(NULL AS DOUBLE)", f"CAST({name} AS VARCHAR)") for name in texts.split()]
    shown = key or "CAST(NULL AS VARCHAR)"
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {shown} AS key, '{name}' AS metric, {value} AS value, {text} AS text FROM ({table})"
        for name, value, text in parts
    )


def _report() -> str:
    anomalies = f"""SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
        {_percent('count(*) FILTER (WHERE is_anomaly)', 'count(*)')} AS anomaly_percent FROM tx"""
    columns = " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, 'REQUIRED' AS state, count("{name}") AS filled_cells, count(*) AS row_count FROM tx"""
        for name in contract.COLUMNS
    )
    failing = _failing("tx", _TYPED_RULES)[1:]
    valid = _row_validation("tx", _TYPED_RULES)[1:]
    samples = f"""WITH {failing} ORDER BY transaction_id, "timestamp", reasons LIMIT 5"""
    counts = "season_transactions other_transactions season_daily_avg other_daily_avg season_multiplier"
    return " UNION ALL ".join([
        _report_rows("column_check", columns, "column_name", "filled_cells row_count", "state"),
        _report_rows("row_validation", f"WITH {valid}", None, "valid_count invalid_count is_valid"),
        _report_rows("failing_samples", f"""SELECT transaction_id, CAST("timestamp" AS VARCHAR) AS "timestamp", reasons FROM ({samples})""",
                     "transaction_id", "", "timestamp reasons"),
        _report_rows("channel_share", _share("channel"), "value", "n share"),
        _report_rows("geo_summary", _GEO_SUMMARY, None, "capital_percent port_percent other_percent"),
        _report_rows("top_regions", _share("sender_wilaya", "ORDER BY n DESC, value LIMIT 10"), "value", "n share"),
        _report_rows("type_count", "SELECT transaction_type AS value, count(*) AS n FROM tx GROUP BY ALL", "value", "n"),
        _report_rows("anomaly_summary", anomalies, None, "anomaly_count anomaly_percent"),
        _report_rows("anomaly_type_count", "SELECT anomaly_type AS value, count(*) AS n FROM tx GROUP BY ALL", "value", "n"),
        _report_rows("daily_volume_summary", _DAILY_SUMMARY, None, "days mean_rows min_rows max_rows"),
        _report_rows("season_compare", _periods(_SEASON, "season"), None, counts),
        _report_rows("salary_compare", _periods(_SALARY, "salary"), None, counts.replace("season", "salary")),
    ])


_EXPECTED = ", ".join(
    f"('{mix}', '{value}', {share}::DOUBLE)"
    for mix, shares in dimensions.EXPECTED_MIXES.items()
    for value, share in shares.items()
)
_MIX_CASES = {
    "operator": ("operator", "true"),
    "sender_wilaya": ("sender_wilaya", "true"),
    "channel_urban": ("coalesce(channel, '')", f"NOT {_RURAL}"),
    "channel_rural": ("coalesce(channel, '')", _RURAL),
    "type_salary_days": ("transaction_type", _SALARY_DAY),
    "type_other_days": ("transaction_type", f"NOT ({_SALARY_DAY})"),
    "bill_provider": ("bill_provider", "transaction_type = 'BILL_PAY' AND bill_provider IS NOT NULL"),
    "origin_country": ("origin_country", "transaction_type = 'CASH_IN' AND origin_country IS NOT NULL"),
}
_MIX_COUNTS = " UNION ALL ".join(
    f"SELECT '{mix}' AS mix, {value} AS value, count(*) AS n FROM tx WHERE {condition} GROUP BY ALL"
    for mix, (value, condition) in _MIX_CASES.items()
)
_MIX_DRIFT = f"""SELECT mix, value, coalesce(n, 0) AS n, coalesce(share, 0.0) AS observed_share,
  coalesce(expected_share, 0.0) AS expected_share,
  round_even(coalesce(share, 0.0) - coalesce(expected_share, 0.0), 2) AS difference
FROM (SELECT *, {_percent('n', 'sum(n) OVER (PARTITION BY mix)')} AS share FROM ({_MIX_COUNTS}))
FULL JOIN (SELECT * FROM (VALUES {_EXPECTED}) AS t(mix, value, expected_share)) USING (mix, value)"""

_SEASONAL = f"""SELECT tx_date, w::DOUBLE AS weight, round_even(w::DOUBLE / total, 6) AS expected_share,
  round_even(running::DOUBLE / total, 6) AS running_share, n AS observed_rows,
  {_ratio('n * total', 'w::DOUBLE * sum(n) OVER ()')} AS observed_to_expected
FROM (SELECT tx_date, w, running, total, coalesce(n, 0) AS n FROM (
  SELECT tx_date, w, sum(w) OVER (ORDER BY tx_date) AS running, CAST(sum(w) OVER () AS DOUBLE) AS total FROM (
    SELECT tx_date, CAST((CASE WHEN {_SEASON} THEN 2.5 ELSE 1.0 END) * (CASE WHEN {_SALARY} THEN 1.8 ELSE 1.0 END) AS DECIMAL(6,2)) AS w
    FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS tx_date)))
  LEFT JOIN ({_DAILY}) USING (tx_date))
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*), NULL FROM tx
WHERE NOT coalesce(CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30', false)"""

_RANGES = ", ".join(
    f"('{key}', {low}::DECIMAL(18,2), {high}::DECIMAL(18,2))" for key, (low, high) in dimensions.AMOUNT_RANGES.items()
)
_RANGED = f"""ranged AS (
  SELECT * FROM (SELECT *, CASE
      WHEN transaction_type = 'BILL_PAY' AND bill_provider IN ('SOMELEC', 'SNDE', 'MAURITEL', 'CHINGUITEL') THEN 'BILL_PAY/' || bill_provider
      WHEN transaction_type = 'CASH_IN' AND origin_country IS NOT NULL THEN 'CASH_IN/DIASPORA'
      ELSE transaction_type END AS range_key FROM tx)
  LEFT JOIN (VALUES {_RANGES}) AS t(range_key, low, high) USING (range_key)
)"""
_AMOUNT_FLAGS = f"""{_RANGED},
medians AS (SELECT transaction_type, quantile_cont(amount::DOUBLE, 0.5) AS median_amount FROM tx GROUP BY ALL),
amounts AS (SELECT *, coalesce(amount > high, false) AS above_range,
    coalesce(amount::DOUBLE >= median_amount * 10, false) AS above_median FROM ranged LEFT JOIN medians USING (transaction_type))"""

_FEE_VERDICT = """CASE WHEN transaction_type IN ('AIRTIME', 'BILL_PAY') AND fees <> 0 THEN 'NOT_FREE'
  WHEN transaction_type IN ('AIRTIME', 'BILL_PAY') OR (status = 'FAILED' AND fees = 0) THEN NULL
  WHEN fees < amount * 0.005 - 0.005 THEN 'TOO_LOW' WHEN fees > amount * 0.02 + 0.005 THEN 'TOO_HIGH' END"""

_HOURS = f"""SELECT {_IN_SEASON} AS in_season, hour("timestamp")::INT AS hour, count(*) AS n FROM tx GROUP BY ALL"""


def _within(counts: str, keys: str) -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    return f"SELECT *, {_percent('n', f'sum(n) OVER ({over})')} AS share FROM ({counts})"


_TYPE_MIX = ", ".join(
    f"{_percent(f'''count(*) FILTER (WHERE transaction_type = '{kind}')''', 'count(*)')} AS {kind.lower()}_percent"
    for kind in contract.TRANSACTION_TYPES
)


def _modal(key: str, value: str, source: str = "tx") -> str:
    """Most frequent value, first by name of equal ones, null last."""
    return f"""SELECT {key}, {value}, n, all_n FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {value} ASC NULLS LAST) AS place,
         sum(n) OVER (PARTITION BY {key}) AS all_n
  FROM (SELECT {key}, {value}, count(*) AS n FROM {source} GROUP BY ALL)) WHERE place = 1"""


_ACCOUNTS = f""", sent AS (SELECT sender_id AS account_id, count(*) AS sent_rows, sum(amount) AS sent_amount FROM tx GROUP BY ALL),
received AS (SELECT receiver_id AS account_id, count(*) AS received_rows, sum(amount) AS received_amount FROM tx GROUP BY ALL),
accounts AS (SELECT account_id, coalesce(sent_rows, 0) AS sent_rows, coalesce(received_rows, 0) AS received_rows,
  CAST(coalesce(sent_amount, 0) AS DECIMAL(38,2)) AS sent_amount, CAST(coalesce(received_amount, 0) AS DECIMAL(38,2)) AS received_amount
  FROM sent FULL JOIN received USING (account_id)),
cuts AS (SELECT quantile_cont(sent_rows::DOUBLE, 0.6) AS p60, quantile_cont(sent_rows::DOUBLE, 0.9) AS p90 FROM accounts)
SELECT account_id, sent_rows, received_rows, sent_amount, received_amount, modal_region, modal_operator, modal_channel,
  CASE WHEN sent_rows <= p60 THEN 'LOW' WHEN sent_rows <= p90 THEN 'MEDIUM' ELSE 'HIGH' END AS tier
FROM accounts CROSS JOIN cuts
LEFT JOIN (SELECT sender_id AS account_id, sender_wilaya AS modal_region FROM ({_modal('sender_id', 'sender_wilaya')})) USING (account_id)
LEFT JOIN (SELECT sender_id AS account_id, operator AS modal_operator FROM ({_modal('sender_id', 'operator')})) USING (account_id)
LEFT JOIN (SELECT sender_id AS account_id, channel AS modal_channel FROM ({_modal('sender_id', 'channel')})) USING (account_id)"""

_CORRIDOR_COLUMNS = ", ".join(
    f"""count(*) FILTER (WHERE receiver_wilaya = '{name}') AS "{name}" """ for name in contract.REGIONS
)


def _frame(keys: str, seconds: int, back: bool = True) -> str:
    side = f"{seconds} PRECEDING AND CURRENT ROW" if back else f"CURRENT ROW AND {seconds} FOLLOWING"
    return f"(PARTITION BY {keys} ORDER BY sec RANGE BETWEEN {side})"


def _sequence(name: str, where: str, keys: str, seconds: int, test: str) -> str:
    """Rows of a sequence detector with their frame measures, the alert, and membership."""
    frame = _frame(keys, seconds)
    return f"""{name}_rows AS (
  SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS sec FROM tx WHERE {where}
),
{name}_frames AS (
  SELECT *, count(*) OVER {frame} AS frame_n, sum(amount) OVER {frame} AS frame_total, min(amount) OVER {frame} AS frame_low,
    max(amount) OVER {frame} AS frame_high, min(sec) OVER {frame} AS first_sec,
    max(sec) OVER (PARTITION BY {keys} ORDER BY sec RANGE BETWEEN {seconds} PRECEDING AND 1 PRECEDING) AS previous_sec,
    count(DISTINCT sender_id) OVER {frame} AS members
  FROM {name}_rows
),
{name}_alerts AS (SELECT * FROM {name}_frames WHERE {test}),
{name}_members AS (
  SELECT * FROM (SELECT *, bool_or(alert) OVER {_frame(keys, seconds, back=False)} AS member
                 FROM (SELECT *, coalesce({test}, false) AS alert FROM {name}_frames)) WHERE member
)"""


_SPLIT = _sequence(
    "split",
    "transaction_type = 'TRANSFER' AND status = 'SUCCESS'",
    "sender_id, receiver_id",
    864000,
    "frame_n >= 2 AND frame_high * 0.5 <= frame_low * 1.5 + 0.01 AND frame_total >= 1000",
)
_SMALL = "transaction_type IN ('TRANSFER', 'AIRTIME', 'MERCHANT') AND status = 'SUCCESS' AND amount BETWEEN 100 AND 5000"
_BURST = _sequence("burst", _SMALL, "sender_id", 86400, "frame_n >= 4")
_INCOMING = _sequence("incoming", _SMALL, "receiver_id", 86400, "frame_n >= 4")
_CIRCLE = _sequence("circle", "transaction_type = 'TRANSFER'", "receiver_id, amount", 172800, "members >= 3")

_DAY_CIRCLE = _sequence(
    "daily", "transaction_type = 'TRANSFER'", 'receiver_id, amount, CAST("timestamp" AS DATE)', 86400, "members >= 2"
)

# Rounds of one amount that are six to eight days apart and have a quarter of their people in common.
_TURNS = f"""{_DAY_CIRCLE},
people AS (
  SELECT DISTINCT receiver_id, amount, CAST("timestamp" AS DATE) AS day, unnest([sender_id, receiver_id]) AS member FROM daily_members
),
rounds AS (SELECT receiver_id, amount, day, count(*) AS n FROM people GROUP BY ALL),
pairs AS (
  SELECT a.receiver_id, a.amount, a.day, b.receiver_id AS earlier_receiver, b.day AS earlier_day,
    (SELECT count(*) FROM people p JOIN people q USING (amount, member) WHERE p.receiver_id = a.receiver_id AND p.amount = a.amount
     AND p.day = a.day AND q.receiver_id = b.receiver_id AND q.day = b.day) AS common, a.n + b.n AS ends
  FROM rounds a JOIN rounds b ON a.amount = b.amount AND a.day - b.day BETWEEN 6 AND 8
),
followed AS (
  SELECT * FROM pairs WHERE 100 * common >= 25 * (ends - common)
  QUALIFY row_number() OVER (PARTITION BY receiver_id, amount, day
    ORDER BY common / (ends - common) DESC, earlier_day DESC, earlier_receiver) = 1
),
climbed AS (
  SELECT receiver_id, amount, day, earlier_receiver AS root_receiver, earlier_day AS root_day FROM followed
  UNION ALL
  SELECT c.receiver_id, c.amount, c.day, f.earlier_receiver, f.earlier_day FROM climbed c
  JOIN followed f ON f.receiver_id = c.root_receiver AND f.amount = c.amount AND f.day = c.root_day
),
roots AS (
  SELECT * FROM climbed QUALIFY row_number() OVER (PARTITION BY receiver_id, amount, day ORDER BY root_day) = 1
),
placed AS (
  SELECT * FROM roots UNION SELECT root_receiver, amount, root_day, root_receiver, root_day FROM roots
),
circle_sizes AS (
  SELECT root_receiver, amount, root_day, count(DISTINCT member) AS n_members
  FROM placed JOIN people USING (receiver_id, amount, day) GROUP BY ALL
),
turns AS (
  SELECT root_receiver AS first_beneficiary, root_day AS first_day, amount, row_number() OVER (PARTITION BY root_receiver, root_day, amount
      ORDER BY day, receiver_id) AS turn, day, receiver_id AS beneficiary, n - 1 AS payers, n_members - n AS missing
  FROM placed JOIN rounds USING (receiver_id, amount, day) JOIN circle_sizes USING (root_receiver, amount, root_day)
)"""

_OUTAGE = f"""SELECT operator, date_trunc('day', "timestamp")::TIMESTAMP AS window_start, count(*) AS n,
  count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'FAILED' AND fees = 0) AS failed_without_fees,
  round_even(count(*) FILTER (WHERE status = 'FAILED') / count(*) * 100, 2) AS failure_rate,
  round_even(count(*) FILTER (WHERE status = 'FAILED') / count(*) * 100, 2) >= 10 AS outage
FROM tx GROUP BY ALL"""

_HOMES = _modal("receiver_id", "receiver_wilaya", "(SELECT * FROM tx WHERE receiver_wilaya IS NOT NULL)")
_UNUSUAL = f"""SELECT transaction_id, sender_id, receiver_id, sender_wilaya, receiver_wilaya, home_region
FROM tx JOIN (SELECT receiver_id, receiver_wilaya AS home_region FROM ({_HOMES})) USING (receiver_id)
WHERE receiver_wilaya <> home_region"""

_LABELLED = f"""labelled AS (
  SELECT a.transaction_id, a."timestamp", a.anomaly_type, CASE
    WHEN s.sec IS NOT NULL AND a.transaction_type = 'TRANSFER' AND a.status = 'SUCCESS' THEN 'STRUCTURING'
    WHEN b.sec IS NOT NULL AND {_SMALL.replace('transaction_type', 'a.transaction_type').replace('status', 'a.status').replace('amount', 'a.amount')} THEN 'HIGH_FREQUENCY'
    WHEN above_range OR above_median THEN 'HIGH_AMOUNT'
    WHEN o.outage AND a.status = 'FAILED' AND a.fees = 0 THEN 'OPERATOR_OUTAGE'
    WHEN a.receiver_wilaya <> h.home_region THEN 'UNUSUAL_LOCATION' ELSE 'NONE' END AS rule_label
  FROM (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS sec FROM amounts) a
  LEFT JOIN (SELECT DISTINCT sender_id, receiver_id, sec FROM split_members) s
    ON a.sender_id = s.sender_id AND a.receiver_id = s.receiver_id AND a.sec = s.sec
  LEFT JOIN (SELECT DISTINCT sender_id, sec FROM burst_members) b ON a.sender_id = b.sender_id AND a.sec = b.sec
  LEFT JOIN ({_OUTAGE}) o ON a.operator = o.operator AND date_trunc('day', a."timestamp")::TIMESTAMP = o.window_start
  LEFT JOIN (SELECT receiver_id, receiver_wilaya AS home_region FROM ({_HOMES})) h ON a.receiver_id = h.receiver_id
)"""

_SCORES = f"""SELECT label,
  count(*) FILTER (WHERE coalesce(anomaly_type = label, false) AND rule_label = label) AS hits,
  count(*) FILTER (WHERE NOT coalesce(anomaly_type = label, false) AND rule_label = label) AS false_alarms,
  count(*) FILTER (WHERE coalesce(anomaly_type = label, false) AND rule_label <> label) AS misses
FROM labelled CROSS JOIN (SELECT unnest([{_list(contract.ANOMALY_TYPES)}]) AS label) GROUP BY label"""


def _windows(source: str, keys: str, length: int, slide: int) -> str:
    """Each row in every sliding window that holds it."""
    return f"""SELECT *, make_timestamp(CAST(start_sec AS BIGINT) * 1000000) AS window_start,
  make_timestamp((CAST(start_sec AS BIGINT) + {length}) * 1000000) AS window_end
FROM (SELECT *, unnest(generate_series(sec - sec % {slide} - {length - slide}, sec - sec % {slide}, {slide})) AS start_sec
      FROM (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS sec FROM {source}))
WHERE start_sec + {length} > sec"""


_SESSIONS = """SELECT sender_id, min("timestamp") AS window_start, max("timestamp") + INTERVAL 10 MINUTE AS window_end,
  count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total
FROM (SELECT *, sum(fresh) OVER (PARTITION BY sender_id ORDER BY "timestamp", transaction_id ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, CASE WHEN "timestamp" >= lag("timestamp") OVER (PARTITION BY sender_id ORDER BY "timestamp", transaction_id)
                        + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM tx))
GROUP BY sender_id, run"""

_CANONICAL_TEXT_COLUMNS = """
  coalesce(transaction_id, '') AS transaction_id,
  coalesce(strftime(moment, '%Y-%m-%dT%H:%M:%S.%fZ'), '') AS "timestamp",
  coalesce(sender_id, '') AS sender_id, coalesce(receiver_id, '') AS receiver_id,
  coalesce(CAST(CAST(amt AS DECIMAL(18,2)) AS VARCHAR), '') AS amount, coalesce(currency, '') AS currency,
  coalesce(transaction_type, '') AS transaction_type, coalesce(channel, '') AS channel, coalesce(operator, '') AS operator,
  coalesce(sender_wilaya, '') AS sender_wilaya, coalesce(receiver_wilaya, '') AS receiver_wilaya, coalesce(status, '') AS status,
  coalesce(CAST(CAST(fee AS DECIMAL(18,2)) AS VARCHAR), '') AS fees,
  coalesce(CAST(TRY_CAST(is_ramadan AS BOOLEAN) AS VARCHAR), '') AS is_ramadan,
  coalesce(bill_provider, '') AS bill_provider, coalesce(origin_country, '') AS origin_country,
  coalesce(CAST(TRY_CAST(is_anomaly AS BOOLEAN) AS VARCHAR), '') AS is_anomaly, coalesce(anomaly_type, '') AS anomaly_type"""

_MOMENT = f"""CASE WHEN "timestamp" IS NULL OR NOT {_STAMP_OK} THEN NULL
  WHEN "timestamp" LIKE '%+01:00' THEN CAST(replace("timestamp", '+01:00', '') AS TIMESTAMP) - INTERVAL 1 HOUR
  ELSE CAST(replace(replace("timestamp", '+00:00', ''), 'Z', '') AS TIMESTAMP) END"""


def all_oracles() -> dict[str, str]:
    on_tx = {
        "value_share_channel": _share("channel"),
        "value_share_region": _share("sender_wilaya"),
        "geo_summary": _GEO_SUMMARY,
        "geo_summary_prefix": f"{_GEO} {_GEO_PREFIX_FROM}",
        "type_count": "SELECT transaction_type AS value, count(*) AS n FROM tx GROUP BY ALL",
        "type_share": _share("transaction_type"),
        "anomaly_summary": f"""SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count,
            {_percent('count(*) FILTER (WHERE is_anomaly)', 'count(*)')} AS anomaly_percent FROM tx""",
        "anomaly_type_count": "SELECT anomaly_type AS value, count(*) AS n FROM tx GROUP BY ALL",
        "daily_volume": _DAILY,
        "daily_volume_summary": _DAILY_SUMMARY,
        "season_compare": _periods(_SEASON, "season"),
        "salary_compare": _periods(_SALARY, "salary"),
        "profile_sets": _PROFILE,
        "basic_stats": _BASIC,
        "validation_report": _report(),
        "report_channel_share": _share("channel"),
        "report_geo_summary": _GEO_SUMMARY,
        "report_season_compare": _periods(_SEASON, "season"),
        "report_salary_compare": _periods(_SALARY, "salary"),
        "report_daily_summary": _DAILY_SUMMARY,
        "top_regions": _share("sender_wilaya", "ORDER BY n DESC, value LIMIT 8"),
        "top_ten_regions": _share("sender_wilaya", "ORDER BY n DESC, value LIMIT 10"),
        "column_check": " UNION ALL ".join(
            f"""SELECT '{name}' AS column_name, 'REQUIRED' AS state, count("{name}") AS filled_cells, count(*) AS row_count FROM tx"""
            for name in contract.COLUMNS
        ),
        "duplicate_ids": "SELECT transaction_id, count(*) AS n FROM tx GROUP BY ALL HAVING count(*) > 1",
        "season_flag_check": f"""SELECT transaction_id, "timestamp", NOT is_ramadan AS is_ramadan, {_IN_SEASON} AS expected_flag
            FROM tx WHERE transaction_id LIKE '%00'""",
        "scalar_columns": f"""SELECT transaction_id, CAST(round(amount * CAST(0.0175 AS DECIMAL(5,4)), 2) AS DECIMAL(18,2)) AS charge,
            {_IN_SEASON} AS in_season, CASE WHEN {_IN_SEASON} THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS season_weight,
            {_SALARY_DAY} AS salary_day, CASE WHEN {_SALARY_DAY} THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END AS salary_weight,
            {_WEEKEND} AS weekend,
            "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59' AS in_days,
            "timestamp" AS parsed_time, CAST("timestamp" AS DATE) AS tx_date, CAST(day("timestamp") AS INT) AS day_of_month,
            is_anomaly AS anomaly, sender_wilaya IN ({_list(contract.CAPITAL_REGIONS)}) AS in_capital,
            starts_with(sender_wilaya, 'Nouakchott') AS in_capital_prefix, sender_wilaya = '{contract.PORT_REGION}' AS in_port,
            {_RURAL} AS rural, round(fees::DOUBLE / nullif(amount::DOUBLE, 0), 6) AS fee_rate, sender_id AS account_key FROM tx""",
        "rows_in_days": """SELECT * FROM tx
            WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59'""",
        "parquet_by_date": """SELECT * FROM tx WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""",
        "appended_batches": "SELECT status AS value, count(*) AS n FROM tx GROUP BY ALL",
        "first_rows": """SELECT transaction_id, "timestamp" FROM tx ORDER BY "timestamp", transaction_id LIMIT 100""",
        "mix_drift": _MIX_DRIFT,
        "seasonal_expectation": _SEASONAL,
        "fee_rule": f"""SELECT transaction_id, transaction_type, status, amount, fees, {_FEE_VERDICT} AS verdict
            FROM tx WHERE {_FEE_VERDICT} IS NOT NULL""",
        "fee_rate_profile": """SELECT transaction_type, round(min(rate), 6) AS least_rate,
            round(quantile_cont(rate, 0.5), 6) AS median_rate, round(max(rate), 6) AS greatest_rate
            FROM (SELECT transaction_type, round(fees::DOUBLE / nullif(amount::DOUBLE, 0), 6) AS rate FROM tx)
            WHERE rate IS NOT NULL GROUP BY ALL""",
        "hourly_profile": _within(_HOURS, "in_season"),
        "evening_share": f"""SELECT {_IN_SEASON} AS in_season, count(*) AS n,
            {_percent('count(*) FILTER (WHERE hour("timestamp") BETWEEN 19 AND 23)', 'count(*)')} AS evening_percent,
            {_percent('count(*) FILTER (WHERE hour("timestamp") BETWEEN 7 AND 22)', 'count(*)')} AS daytime_percent
            FROM tx GROUP BY ALL""",
        "type_mix_by_day_class": f"""SELECT CASE WHEN {_SALARY_DAY} THEN 'SALARY_DAYS' ELSE 'OTHER_DAYS' END AS day_class,
            count(*) AS n, {_TYPE_MIX} FROM tx GROUP BY ALL""",
        "channel_mix_by_region_class": _within(
            f"SELECT CASE WHEN {_RURAL} THEN 'RURAL' ELSE 'OTHER' END AS region_class, channel, count(*) AS n FROM tx GROUP BY ALL",
            "region_class",
        ),
        "recurring_bills": """SELECT sender_id, bill_provider, CAST(date_trunc('month', "timestamp") AS DATE) AS month,
            count(*) AS bills, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM tx WHERE transaction_type = 'BILL_PAY' GROUP BY ALL""",
        "bill_payer_share": f"""SELECT *, {_percent('paying_accounts', 'active_accounts')} AS share FROM (
            SELECT CAST(date_trunc('month', "timestamp") AS DATE) AS month, count(DISTINCT sender_id) AS active_accounts,
            count(DISTINCT sender_id) FILTER (WHERE transaction_type = 'BILL_PAY') AS paying_accounts FROM tx GROUP BY ALL)""",
        "bill_day_profile": _within(
            """SELECT bill_provider, CASE WHEN day("timestamp") <= 10 THEN 'DAY_1_10' ELSE 'DAY_11_31' END AS half, count(*) AS n
            FROM tx WHERE transaction_type = 'BILL_PAY' GROUP BY ALL""",
            "bill_provider",
        ),
        "account_consistency": """SELECT sender_id, count(DISTINCT sender_wilaya) AS regions, count(DISTINCT operator) AS operators
            FROM tx GROUP BY ALL HAVING count(DISTINCT sender_wilaya) > 1 OR count(DISTINCT operator) > 1""",
        "channel_loyalty": f"""SELECT sender_id, channel, CAST(all_n AS BIGINT) AS n, {_percent('n', 'all_n')} AS loyalty
            FROM ({_modal('sender_id', 'channel')})""",
        "counterparties": """SELECT account_id, CAST(sum(own) AS BIGINT) AS self_transfers,
            count(DISTINCT other) FILTER (WHERE other <> account_id) AS counterparties FROM (
              SELECT sender_id AS account_id, receiver_id AS other, CASE WHEN sender_id = receiver_id THEN 1 ELSE 0 END AS own FROM tx
              UNION ALL SELECT receiver_id, sender_id, 0 FROM tx) GROUP BY ALL""",
        "diaspora_flow": f"""SELECT day_class, origin_country, n, amount, {_percent('n', 'sum(n) OVER (PARTITION BY day_class)')} AS share,
            {_percent('sum(CASE WHEN origin_country IS NOT NULL THEN n ELSE 0 END) OVER (PARTITION BY day_class)',
                      'sum(n) OVER (PARTITION BY day_class)')} AS abroad_share,
            CASE WHEN day_class = 'WEEKEND' THEN 28.0::DOUBLE ELSE 20.0::DOUBLE END AS expected_abroad_share
            FROM (SELECT CASE WHEN {_WEEKEND} THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_class, origin_country, count(*) AS n,
              CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM tx WHERE transaction_type = 'CASH_IN' GROUP BY ALL)""",
        "corridors": _within(
            """SELECT sender_wilaya, receiver_wilaya, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS amount
            FROM tx GROUP BY ALL""",
            "",
        ),
        "corridor_matrix": f"SELECT sender_wilaya, {_CORRIDOR_COLUMNS} FROM tx GROUP BY ALL",
        "operator_indicators": f"""SELECT operator, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS amount,
            CAST(sum(fees) AS DECIMAL(38,2)) AS fees,
            {_percent("count(*) FILTER (WHERE status = 'SUCCESS')", 'count(*)')} AS success_percent,
            {_percent("count(*) FILTER (WHERE status = 'FAILED')", 'count(*)')} AS failed_percent,
            {_percent("count(*) FILTER (WHERE status = 'PENDING')", 'count(*)')} AS pending_percent FROM tx GROUP BY ALL""",
        "operator_outage": _OUTAGE,
        "unusual_location": _UNUSUAL,
        "stream_dedup": "SELECT DISTINCT transaction_id FROM tx",
        "stream_daily": """SELECT date_trunc('day', "timestamp")::TIMESTAMP AS window_start,
            date_trunc('day', "timestamp")::TIMESTAMP + INTERVAL 1 DAY AS window_end, count(*) AS n FROM tx GROUP BY ALL""",
        "stream_hourly": """SELECT date_trunc('hour', "timestamp") AS window_start,
            date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM tx GROUP BY ALL""",
        "stream_outage": f"SELECT *, window_start + INTERVAL 1 DAY AS window_end FROM ({_OUTAGE})",
        "stream_burst": f"""SELECT sender_id, window_start, window_end, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total
            FROM ({_windows(f'(SELECT * FROM tx WHERE {_SMALL})', 'sender_id', 108000, 21600)}) GROUP BY ALL HAVING count(*) >= 4""",
        "stream_tontine": f"""SELECT receiver_id, amount, window_start, window_end, count(DISTINCT sender_id) AS members,
            count(*) AS payments FROM ({_windows("(SELECT * FROM tx WHERE transaction_type = 'TRANSFER')", '', 216000, 43200)})
            GROUP BY ALL HAVING count(DISTINCT sender_id) >= 3""",
        "stream_tontine_estimate": f"""SELECT receiver_id, amount, window_start, window_end, count(DISTINCT sender_id) AS members,
            true AS within_error FROM ({_windows("(SELECT * FROM tx WHERE transaction_type = 'TRANSFER')", '', 216000, 43200)})
            GROUP BY ALL HAVING count(DISTINCT sender_id) >= 3""",
        "sketched_quantiles": """SELECT transaction_type, count(*) AS n, true AS p10, true AS p50, true AS p90
            FROM tx WHERE amount IS NOT NULL GROUP BY ALL""",
        "dated_range_breaks": """SELECT range_id, count(*) AS n, count(*) FILTER (WHERE amount < low) AS below,
            count(*) FILTER (WHERE amount > high) AS above
            FROM tx JOIN (SELECT transaction_type, sender_wilaya, first_day, low, high, first_day + CAST(rows % 20 AS INTEGER) AS last_day,
                concat_ws('|', transaction_type, sender_wilaya, CAST(first_day AS VARCHAR)) AS range_id
                FROM (SELECT transaction_type, sender_wilaya, CAST("timestamp" AS DATE) AS first_day, min(amount) AS low,
                    max(amount) AS high, count(*) AS rows FROM tx GROUP BY ALL)) r
            ON tx.transaction_type = r.transaction_type AND tx.sender_wilaya = r.sender_wilaya
            AND CAST(tx."timestamp" AS DATE) BETWEEN first_day AND last_day GROUP BY range_id""",
        "dated_seasons": """SELECT CAST("timestamp" AS DATE) AS tx_date, bool_or(busy IS NOT NULL) AS in_season, count(DISTINCT i) AS n
            FROM tx_i LEFT JOIN (SELECT busy FROM (SELECT CAST("timestamp" AS DATE) AS busy, count(*) AS n FROM tx GROUP BY ALL)
                WHERE n > (SELECT avg(n) FROM (SELECT count(*) AS n FROM tx GROUP BY CAST("timestamp" AS DATE)))) s
            ON CAST("timestamp" AS DATE) BETWEEN busy AND busy + 3 GROUP BY ALL""",
        "stream_sessions": _SESSIONS,
        "csv_round_trip": "SELECT * FROM tx",
        "json_round_trip": "SELECT * FROM tx",
        "parquet_round_trip": "SELECT * FROM tx",
    }
    chained = {
        "row_validation": _row_validation("tx", _TYPED_RULES),
        "missing_column_defaults": _row_validation(
            "(SELECT * REPLACE ('MRU' AS currency, 'SUCCESS' AS status, 'made' AS transaction_id) FROM tx)", _TYPED_RULES
        ),
        "violations_by_rule": _by_rule("tx", _TYPED_RULES),
        "row_violations": _failing("tx", _TYPED_RULES),
        "failing_samples": _failing("tx", _TYPED_RULES) + ' ORDER BY transaction_id, "timestamp", reasons LIMIT 5',
        "quarantine": _routes("tx", _TYPED_RULES),
        "stream_validate": _routes("tx", _TYPED_RULES),
        "amount_range": f""", {_RANGED} SELECT transaction_id, range_key, amount, low, high,
            CASE WHEN amount < low THEN 'BELOW' ELSE 'ABOVE' END AS side FROM ranged WHERE amount < low OR amount > high""",
        "high_amount": f""", {_AMOUNT_FLAGS} SELECT transaction_id, transaction_type, amount, high,
            round(median_amount, 4) AS median_amount, above_range, above_median FROM amounts WHERE above_range OR above_median""",
        "account_profile": _ACCOUNTS,
        "structuring": f""", {_SPLIT} SELECT transaction_id, "timestamp", sender_id, receiver_id, amount,
            make_timestamp(first_sec * 1000000) AS first_time, make_timestamp(sec * 1000000) AS last_time,
            frame_n AS n, CAST(frame_total AS DECIMAL(38,2)) AS total FROM split_alerts""",
        "high_frequency": f""", {_BURST} SELECT transaction_id, "timestamp", sender_id, receiver_id, amount, transaction_type,
            make_timestamp(first_sec * 1000000) AS first_time, frame_n AS n, sec - previous_sec AS gap_seconds FROM burst_alerts""",
        "tontine": f""", {_CIRCLE} SELECT transaction_id, "timestamp", sender_id, receiver_id, amount, members FROM circle_alerts""",
        "tontine_suppressed": f""", {_INCOMING}, {_CIRCLE} SELECT transaction_id, "timestamp", sender_id, receiver_id, amount,
            transaction_type, make_timestamp(first_sec * 1000000) AS first_time, frame_n AS n, sec - previous_sec AS gap_seconds
            FROM incoming_alerts a WHERE NOT EXISTS (SELECT 1 FROM circle_members c WHERE c.receiver_id = a.receiver_id
            AND c.amount = a.amount AND c.sec = a.sec AND a.transaction_type = 'TRANSFER')""",
        "circle_turns": f""", RECURSIVE {_TURNS} SELECT first_beneficiary, first_day, amount, CAST(turn AS INTEGER) AS turn, day,
            beneficiary, payers, missing FROM turns""",
        "savings_circles": f""", RECURSIVE {_TURNS} SELECT first_beneficiary, first_day, amount, max(day) AS last_day, count(*) AS rounds,
            max(payers + missing) + 1 AS people, string_agg(beneficiary, ',' ORDER BY turn) AS beneficiaries,
            count(*) - count(DISTINCT beneficiary) AS repeated_turns, CAST(sum(missing) AS BIGINT) AS missing_payments FROM turns GROUP BY ALL""",
        "rule_label": f""", {_SPLIT}, {_BURST}, {_AMOUNT_FLAGS}, {_LABELLED}
            SELECT *, rule_label <> 'NONE' AS rule_flag FROM labelled""",
        "label_scorecard": f""", {_SPLIT}, {_BURST}, {_AMOUNT_FLAGS}, {_LABELLED} SELECT *,
            coalesce(round_even(hits / nullif(hits + false_alarms, 0), 4), 0.0) AS "precision",
            coalesce(round_even(hits / nullif(hits + misses, 0), 4), 0.0) AS recall FROM ({_SCORES})""",
        "alerted_account_rows": f""", {_SPLIT} SELECT transaction_id, "timestamp", sender_id, receiver_id, amount
            FROM tx WHERE sender_id IN (SELECT sender_id FROM split_alerts)""",
    }
    on_raw = {
        "text_row_validation": _row_validation("raw", _TEXT_RULES),
        "text_violations_by_rule": _by_rule("raw", _TEXT_RULES),
        "text_row_violations": _failing("raw", _TEXT_RULES),
        "text_quarantine": _routes("raw", _TEXT_RULES),
        "text_stream_validate": _routes("raw", _TEXT_RULES),
        "text_unreadable_timestamps": f"""SELECT count(*) FILTER (WHERE coalesce({_STAMP_OK}, false)) AS readable_rows,
            count(*) FILTER (WHERE NOT coalesce({_STAMP_OK}, false)) AS unreadable_rows FROM raw""",
        "text_canonical": f"""SELECT {_CANONICAL_TEXT_COLUMNS} FROM (
            SELECT *, {_MOMENT} AS moment, TRY_CAST(amount AS DECIMAL(38,10)) AS amt, TRY_CAST(fees AS DECIMAL(38,10)) AS fee FROM raw)""",
    }
    chained["stream_published_routes"] = chained["stream_validate"]
    chained["stream_exact_burst"] = chained["high_frequency"]
    chained["stream_exact_split"] = chained["structuring"]
    chained["stream_exact_tontine"] = chained["tontine"]
    chained["stream_exact_suppressed"] = chained["tontine_suppressed"]
    on_tx["incremental_profile"] = on_tx["profile_sets"]
    on_raw["text_csv_round_trip"] = on_raw["text_json_round_trip"] = on_raw["text_canonical"]
    found = {name: f"WITH {_EVENTS} {text}" for name, text in on_tx.items()}
    found |= {
        name: f"WITH RECURSIVE {_EVENTS}{text.replace(', RECURSIVE', ',', 1)}" if text.startswith(", RECURSIVE") else f"WITH {_EVENTS}{text}"
        for name, text in chained.items()
    }
    found |= {
        name: f"WITH {_RAW}{text}" if text.startswith(",") else f"WITH {_RAW} {text}" for name, text in on_raw.items()
    }
    return found
