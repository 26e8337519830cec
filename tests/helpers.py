"""Builders shared by the tests."""

import uuid
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from swipewatch import schemas

BUSINESS = datetime(2026, 7, 15, 10, 0, tzinfo=timezone.utc)
OFF_HOURS = datetime(2026, 7, 15, 3, 0, tzinfo=timezone.utc)
CAPE_TOWN, JOHANNESBURG, LONDON = (-33.9249, 18.4241), (-26.2041, 28.0473), (51.5074, -0.1278)


def ago(at, **span):
    return at - timedelta(**span)


def txn(at=BUSINESS, amount="100", customer="C", merchant="M-1", currency="ZAR", category="RETAIL", place=None,
        device=None, kind="CARD_NOT_PRESENT", id=None):
    lat, lon = place if place else (None, None)
    return (id or str(uuid.uuid4()), customer, merchant, Decimal(amount), currency, category, None, lat, lon, device, at, kind)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.TRANSACTION)


def merchants(spark, rows=()):
    return spark.createDataFrame(list(rows), schemas.MERCHANT_LOCATION)
