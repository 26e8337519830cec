"""Explicit schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(19, 4)


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


TRANSACTION = _schema(
    ("transaction_id", T.StringType(), False),
    ("customer_id", T.StringType(), False),
    ("merchant_id", T.StringType(), False),
    ("amount", AMOUNT, False),
    ("currency", T.StringType(), False),
    ("category", T.StringType(), True),
    ("location", T.StringType(), True),
    ("latitude", T.DoubleType(), True),
    ("longitude", T.DoubleType(), True),
    ("device_fingerprint", T.StringType(), True),
    ("timestamp", T.TimestampType(), False),
    ("transaction_type", T.StringType(), True),
)

# What producers put on the wire: the amount is text, absent strings are empty
# and absent coordinates are 0.0.
RAW_EVENT = _schema(
    ("transaction_id", T.StringType(), True),
    ("customer_id", T.StringType(), True),
    ("merchant_id", T.StringType(), True),
    ("amount", T.StringType(), True),
    ("currency", T.StringType(), True),
    ("category", T.StringType(), True),
    ("location", T.StringType(), True),
    ("latitude", T.DoubleType(), True),
    ("longitude", T.DoubleType(), True),
    ("device_fingerprint", T.StringType(), True),
    ("timestamp", T.TimestampType(), True),
    ("transaction_type", T.StringType(), True),
    ("ingest_ts", T.TimestampType(), True),
)

MERCHANT_LOCATION = _schema(
    ("merchant_id", T.StringType(), False),
    ("latitude", T.DoubleType(), False),
    ("longitude", T.DoubleType(), False),
    ("city", T.StringType(), True),
    ("country", T.StringType(), True),
)

VIOLATION = _schema(
    ("rule_name", T.StringType(), False),
    ("rule_version", T.StringType(), False),
    ("description", T.StringType(), True),
    ("severity", T.StringType(), False),
)

OUTCOME_REQUEST = _schema(
    ("event_id", T.StringType(), False),
    ("transaction_id", T.StringType(), False),
    ("outcome", T.StringType(), True),
    ("recorded_at", T.TimestampType(), False),
)

# Test-data table the demo transactions are derived from.
EVENTS = _schema(
    ("event_id", T.LongType(), True),
    ("ts", T.TimestampNTZType(), True),
    ("user_id", T.LongType(), True),
    ("event_type", T.StringType(), True),
    ("value", T.DoubleType(), True),
    ("props", T.StringType(), True),
)

# Fixed values.
TRANSACTION_TYPES = ("CARD_PRESENT", "CARD_NOT_PRESENT", "CONTACTLESS", "ATM")
PHYSICAL_TYPES = ("CARD_PRESENT", "CONTACTLESS", "ATM")
CARD_NOT_PRESENT = "CARD_NOT_PRESENT"
STATUSES = ("PENDING", "ASSESSED", "FAILED")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
CLEARED, PENDING_REVIEW, FLAGGED = "CLEARED", "PENDING_REVIEW", "FLAGGED"
DISPOSITIONS = (CLEARED, PENDING_REVIEW, FLAGGED)
UNRESOLVED, CONFIRMED_FRAUD, FALSE_POSITIVE = "UNRESOLVED", "CONFIRMED_FRAUD", "FALSE_POSITIVE"
OUTCOMES = (UNRESOLVED, CONFIRMED_FRAUD, FALSE_POSITIVE)
