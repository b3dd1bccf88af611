"""Table layouts and CSV field maps of the three ledgers.

A field map lists ``(column, CSV header, kind)`` in source order. Kinds:
``required`` / ``text`` (string), ``decimal``, ``timestamp`` (no offset), ``date``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: CSV headers of the three exports ----------------------
COMMON = [
    ("zoho_record_id", "Record Id", "required"),
    ("transaction_id", "Transaction ID", "text"),
    ("source_record_id", "RecordID", "text"),
    ("country", "Country", "text"),
    ("status", "Status", "text"),
    ("created_on", "Created On", "timestamp"),
    ("source_change_at", "Change Log Time", "timestamp"),
]
FIELD_MAPS = {
    "wallet": COMMON + [
        ("reference", "Reference", "text"),
        ("wallet_id", "Wallet.id", "text"),
        ("wallet_label", "Wallet", "text"),
        ("transaction_type", "Type", "text"),
        ("settled_against", "Settled Against", "text"),
        ("narration", "Narration", "text"),
        ("amount", "Amount", "decimal"),
        ("opening_balance", "Opening Balance", "decimal"),
        ("available_balance", "Available Balance", "decimal"),
        ("hold_amount", "Hold Amount", "decimal"),
        ("crm_created_at", "Created Time", "timestamp"),
        ("source_modified_at", "Modified Time", "timestamp"),
    ],
    "swap": COMMON + [
        ("swap_reference", "Battery Swapping ID", "text"),
        ("customer_id", "Customer.id", "text"),
        ("customer_label", "Customer", "text"),
        ("customer_name", "Customer Name", "text"),
        ("vehicle_id", "Vehicle ID", "text"),
        ("vehicle_registration", "Vehicle Reg No", "text"),
        ("station_id", "Swap Station.id", "text"),
        ("station_label", "Swap Station", "text"),
        ("station_code", "Station", "text"),
        ("in_battery_oem", "In Battery OEM No", "text"),
        ("out_battery_oem", "Out Battery OEM No", "text"),
        ("in_battery_serial", "In Battery Serial No", "text"),
        ("out_battery_serial", "Out Battery Serial No", "text"),
        ("city", "City", "text"),
        ("payment_method", "Pay Method", "text"),
        ("swap_amount", "Swap Amount", "decimal"),
        ("swap_date", "Swap Date", "date"),
        ("source_modified_at", "Last Modified On", "timestamp"),
    ],
    "wallet_master": [
        ("zoho_record_id", "Record Id", "required"),
        ("wallet_code", "Wallet ID", "text"),
        ("source_record_id", "RecordID", "text"),
        ("customer_crm_id", "Customer.id", "text"),
        ("customer_label", "Customer", "text"),
        ("customer_business_id", "Customer ID", "text"),
        ("customer_name", "Customer Name", "text"),
        ("country", "Country", "text"),
        ("country_code", "Country Code", "text"),
        ("currency", "Currency", "text"),
        ("category", "Category", "text"),
        ("opening_balance", "Opening Balance", "decimal"),
        ("hold_amount", "Hold Amount", "decimal"),
        ("available_balance", "Available Balance", "decimal"),
        ("created_on", "Created On", "timestamp"),
        ("source_modified_at", "Modified Time", "timestamp"),
        ("source_change_at", "Change Log Time", "timestamp"),
    ],
}
TABLES = {"wallet": "wallet_transactions", "swap": "swap_transactions", "wallet_master": "wallets"}
# Load order of a configured multi-file load.
LOAD_ORDER = ("wallet_master", "wallet", "swap")
# Columns that never reach storage nor the raw record.
SENSITIVE_HEADERS = ("Wallet Pin",)
# Amount column profiled per dataset.
AMOUNT_FIELD = {"wallet": "amount", "swap": "swap_amount", "wallet_master": "available_balance"}
# --- end of fixed values -------------------------------------------------

# Exact money: wide enough for 22 integer digits, 6 fractional digits.
MONEY = T.DecimalType(38, 12)
PROVENANCE = ["source_file", "source_row_number", "raw_record", "imported_at"]

_KIND_TYPES = {
    "required": T.StringType(),
    "text": T.StringType(),
    "decimal": MONEY,
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
}

# Stored column order of each table (matches the ledger DDL).
TABLE_COLUMNS = {
    "wallet": [
        "zoho_record_id", "transaction_id", "reference", "source_record_id", "wallet_id",
        "wallet_label", "country", "transaction_type", "status", "settled_against",
        "narration", "amount", "opening_balance", "available_balance", "hold_amount",
        "created_on", "crm_created_at", "source_modified_at", "source_change_at",
    ],
    "swap": [
        "zoho_record_id", "swap_reference", "transaction_id", "source_record_id",
        "customer_id", "customer_label", "customer_name", "vehicle_id",
        "vehicle_registration", "station_id", "station_label", "station_code",
        "in_battery_oem", "out_battery_oem", "in_battery_serial", "out_battery_serial",
        "country", "city", "payment_method", "status", "swap_amount", "swap_date",
        "created_on", "source_modified_at", "source_change_at",
    ],
    "wallet_master": [
        "zoho_record_id", "wallet_code", "source_record_id", "customer_crm_id",
        "customer_label", "customer_business_id", "customer_name", "country",
        "country_code", "currency", "category", "opening_balance", "hold_amount",
        "available_balance", "created_on", "source_modified_at", "source_change_at",
    ],
}


def kind_of(dataset: str) -> dict[str, str]:
    return {col: kind for col, _, kind in FIELD_MAPS[dataset]}


def headers_of(dataset: str) -> list[str]:
    return [header for _, header, _ in FIELD_MAPS[dataset]]


SCALE_SUFFIX = "_scale"


def scale_columns(dataset: str) -> list[str]:
    """Written scale (fractional digits as exported) of each decimal column:
    values are exact DECIMAL(38,12); the scale keeps ``120.10`` printing as
    ``120.10``."""
    kinds = kind_of(dataset)
    return [c + SCALE_SUFFIX for c in TABLE_COLUMNS[dataset] if kinds[c] == "decimal"]


def stored_columns(dataset: str) -> list[str]:
    return TABLE_COLUMNS[dataset] + scale_columns(dataset) + PROVENANCE


def table_schema(dataset: str) -> T.StructType:
    kinds = kind_of(dataset)
    fields = [T.StructField(c, _KIND_TYPES[kinds[c]], c != "zoho_record_id") for c in TABLE_COLUMNS[dataset]]
    fields += [T.StructField(c, T.IntegerType(), True) for c in scale_columns(dataset)]
    fields += [
        T.StructField("source_file", T.StringType(), False),
        T.StructField("source_row_number", T.LongType(), False),
        T.StructField("raw_record", T.StringType(), False),
        T.StructField("imported_at", T.TimestampType(), True),
    ]
    return T.StructType(fields)
