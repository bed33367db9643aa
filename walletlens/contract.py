"""The transaction record: columns, types, allowed values and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# The record layout and the values a field may take.

COLUMNS = [
    "transaction_id",
    "timestamp",
    "sender_id",
    "receiver_id",
    "amount",
    "currency",
    "transaction_type",
    "channel",
    "operator",
    "sender_wilaya",
    "receiver_wilaya",
    "status",
    "fees",
    "is_ramadan",
    "bill_provider",
    "origin_country",
    "is_anomaly",
    "anomaly_type",
]

CURRENCIES = ["MRU", "XOF", "USD"]

TRANSACTION_TYPES = ["TRANSFER", "BILL_PAY", "MERCHANT", "CASH_IN", "CASH_OUT", "AIRTIME"]

CHANNELS = ["USSD", "APP", "AGENT"]

OPERATORS = [
    "Bankily",
    "Masrvi",
    "Sedad",
    "Click",
    "bimbank Mobile",
    "Bamis Digital",
    "GazaPay",
    "BaridCash",
    "BCIpay",
]

REGIONS = [
    "Nouakchott-Ouest",
    "Nouakchott-Nord",
    "Nouakchott-Sud",
    "Hodh El Chargui",
    "Hodh El Gharbi",
    "Assaba",
    "Gorgol",
    "Brakna",
    "Trarza",
    "Adrar",
    "Dakhlet Nouadhibou",
    "Tagant",
    "Guidimakha",
    "Tiris Zemmour",
    "Inchiri",
]

CAPITAL_REGIONS = ["Nouakchott-Ouest", "Nouakchott-Nord", "Nouakchott-Sud"]

CAPITAL_PREFIX = "Nouakchott"

PORT_REGION = "Dakhlet Nouadhibou"

RURAL_REGIONS = [
    "Adrar",
    "Tagant",
    "Tiris Zemmour",
    "Inchiri",
    "Hodh El Chargui",
    "Hodh El Gharbi",
    "Guidimakha",
]


STATUSES = ["SUCCESS", "FAILED", "PENDING"]

ANOMALY_TYPES = [
    "NONE",
    "HIGH_AMOUNT",
    "STRUCTURING",
    "OPERATOR_OUTAGE",
    "HIGH_FREQUENCY",
    "UNUSUAL_LOCATION",
]

BILL_PROVIDERS = ["SOMELEC", "SNDE", "MAURITEL", "CHINGUITEL", "MATTEL"]

MAX_AMOUNT = "500000.00"

ACCOUNT_PATTERN = r"^ACC_\p{Nd}{5}\z"

COUNTRY_PATTERN = r"^[A-Z]{2}\z"

# Text accepted for a boolean field, in lower case.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "off", "f", "false", "n", "no"]

# Values for a column that a source does not have at all. A null cell in a column that
# exists is not replaced. The id is filled by uuid().
COLUMN_DEFAULTS = {
    "currency": "MRU",
    "fees": "0.00",
    "status": "SUCCESS",
    "is_ramadan": "false",
    "bill_provider": None,
    "origin_country": None,
    "is_anomaly": "false",
    "anomaly_type": "NONE",
}

MONEY = T.DecimalType(18, 2)

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField(name, {
            "timestamp": T.TimestampType(),
            "amount": MONEY,
            "fees": MONEY,
            "is_ramadan": T.BooleanType(),
            "is_anomaly": T.BooleanType(),
        }.get(name, T.StringType()))
        for name in COLUMNS
    ]
)

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in COLUMNS])
