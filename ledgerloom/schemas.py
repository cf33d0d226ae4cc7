"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql.types import (
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = DecimalType(18, 2)
TOTAL = DecimalType(30, 2)


def _struct(spec: str, types: dict | None = None) -> StructType:
    types = types or {}
    return StructType([StructField(name, types.get(name, StringType())) for name in spec.split()])


# Column names and order of a delivered transaction file.
TRANSACTION_COLUMNS = [
    "transaction_id",
    "account_id",
    "transaction_date",
    "transaction_type",
    "amount",
    "currency",
]

RAW_TRANSACTION = _struct(" ".join(TRANSACTION_COLUMNS))
TYPED = {"transaction_date": DateType(), "amount": MONEY}
TYPED_TRANSACTION = _struct(" ".join(TRANSACTION_COLUMNS), TYPED)

CUSTOMER = _struct("customer_id customer_name email customer_segment")
BRANCH = _struct("branch_id branch_name city state")
ACCOUNT = _struct("account_id customer_id branch_id account_type account_status")
BANK_TRANSACTION = _struct(" ".join(TRANSACTION_COLUMNS) + " source_file", TYPED)

SEED_CUSTOMER = _struct("customer_id customer_name city customer_segment")
SEED_ACCOUNT = _struct("account_id customer_id account_type opened_date account_status")
SEED_TRANSACTION = _struct("transaction_id account_id transaction_date amount transaction_type currency")

RUN_EVENT = _struct("run_id status status_reason event_ts", {"event_ts": TimestampType()})
FILE_EVENT = _struct(
    "run_id source_filename branch_id file_date file_sha256 source_rows accepted_rows rejected_rows "
    "file_status note event_ts",
    {
        "file_date": DateType(),
        "source_rows": LongType(),
        "accepted_rows": LongType(),
        "rejected_rows": LongType(),
        "event_ts": TimestampType(),
    },
)

_LINEAGE = "run_id source_filename branch_id source_row_number "
_LINEAGE_TYPES = {"source_row_number": LongType(), "load_timestamp": TimestampType()}
BRONZE = _struct(
    "bronze_id " + _LINEAGE + "load_timestamp " + " ".join(TRANSACTION_COLUMNS), _LINEAGE_TYPES
)
SILVER = _struct(
    " ".join(TRANSACTION_COLUMNS) + " source_filename source_row_number bronze_id branch_id run_id",
    {**_LINEAGE_TYPES, **TYPED},
)
EXCEPTIONS = _struct(
    "exception_id " + _LINEAGE + "bronze_id " + " ".join(TRANSACTION_COLUMNS) + " rejection_reasons",
    _LINEAGE_TYPES,
)
GOLD = _struct(
    "branch_id transaction_date transaction_type transaction_count total_amount",
    {"transaction_date": DateType(), "transaction_count": LongType(), "total_amount": TOTAL},
)

# what one run adds to gold
GOLD_PART = StructType([*GOLD.fields, StructField("run_id", StringType())])

DIM_DATE = _struct(
    "date_key full_date year month day day_name",
    {
        "date_key": IntegerType(),
        "full_date": DateType(),
        "year": IntegerType(),
        "month": IntegerType(),
        "day": IntegerType(),
    },
)

CUSTOMER_EXCEPTION_COLUMNS = [
    "exception_id",
    "entity_type",
    "source_filename",
    "source_row_number",
    "customer_id",
    "account_id",
    "transaction_id",
    "raw_record",
    "rejection_reasons",
    "recorded_at",
]
