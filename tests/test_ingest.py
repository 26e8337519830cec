import uuid
from datetime import timedelta
from decimal import Decimal

import pytest

from helpers import BUSINESS
from swipewatch import schemas
from swipewatch.sources import ingest

FIELDS = schemas.RAW_EVENT.fieldNames()


def event(**changes):
    base = dict(transaction_id=str(uuid.uuid4()), customer_id="C", merchant_id="M", amount="12.50", currency="ZAR",
                category="", location="", latitude=0.0, longitude=0.0, device_fingerprint="", timestamp=BUSINESS,
                transaction_type="ATM", ingest_ts=BUSINESS + timedelta(seconds=1))
    return tuple({**base, **changes}[f] for f in FIELDS)


def frame(spark, *events):
    return spark.createDataFrame(list(events), schemas.RAW_EVENT)


def test_absent_values(spark):
    row = ingest.normalise_events(frame(spark, event())).first()
    assert all(row[c] is None for c in ("category", "location", "device_fingerprint", "latitude", "longitude"))
    assert row["amount"] == Decimal("12.5000") and row["transaction_type"] == "ATM"


def test_coordinates_are_absent_one_by_one(spark):
    row = ingest.normalise_events(frame(spark, event(latitude=0.0, longitude=18.4))).first()
    assert row["latitude"] is None and row["longitude"] == 18.4


def test_unspecified_channel_and_missing_time(spark):
    row = ingest.normalise_events(frame(spark, event(transaction_type="TRANSACTION_TYPE_UNSPECIFIED", timestamp=None))).first()
    assert row["transaction_type"] == "CARD_NOT_PRESENT"
    assert row["timestamp"].replace(tzinfo=BUSINESS.tzinfo) == BUSINESS + timedelta(seconds=1)


@pytest.mark.parametrize("changes,field", [
    (dict(transaction_id="nope"), "transaction_id"), (dict(transaction_id=None), "transaction_id"),
    (dict(amount="x"), "amount"), (dict(amount="1" * 16), "amount"), (dict(currency="TOOLONG"), "currency"),
    (dict(customer_id=None), "customer_id"), (dict(merchant_id="m" * 65), "merchant_id"),
    (dict(device_fingerprint="d" * 129), "device_fingerprint"), (dict(category="c" * 65), "category")])
def test_stream_profile(spark, changes, field):
    valid, rejected = ingest.validate(ingest.normalise_events(frame(spark, event(), event(**changes))))
    assert valid.count() == 1
    assert [e["field"] for e in rejected.first()["errors"]] == [field]


def test_stream_profile_accepts_what_storage_accepts(spark):
    valid, _ = ingest.validate(ingest.normalise_events(frame(
        spark, event(customer_id=""), event(amount="-5"), event(currency="z"), event(latitude=500.0))))
    assert valid.count() == 4


@pytest.mark.parametrize("changes,fields", [
    (dict(customer_id=" "), ["customer_id"]), (dict(amount="0"), ["amount"]), (dict(amount="-1"), ["amount"]),
    (dict(amount="1.00001"), ["amount"]), (dict(amount="1.50000"), []), (dict(amount="1" + "0" * 15), ["amount"]),
    (dict(amount="9" * 15 + ".9999"), []), (dict(currency="zar"), ["currency"]), (dict(currency="ZARX"), ["currency"]),
    (dict(latitude=90.0), []), (dict(latitude=90.1), ["latitude"]), (dict(longitude=-180.5), ["longitude"]),
    (dict(transaction_type="CHEQUE"), ["transaction_type"]), (dict(transaction_type=None), []),
    (dict(transaction_id=None), [])])
def test_submit_profile(spark, changes, fields):
    row = ingest.with_submit_errors(frame(spark, event(**changes))).first()
    assert [e["field"] for e in row["errors"]] == fields


def test_unknown_profile(spark):
    with pytest.raises(ValueError):
        ingest.validate(frame(spark, event()), "other")


def test_quarantine_shape(spark):
    row = ingest.quarantine(ingest.validate(ingest.normalise_events(frame(spark, event(amount="x", currency="LONG"))))[1]).first()
    assert row["reason"] == "amount: not a number of at most 15 and 4 digits; currency: longer than 3"
    assert row["attempts"] == 3 and row["status"] == "FAILED" and row["sent_amount"] == "x"


def test_first_delivery_wins(spark):
    one = str(uuid.uuid4())
    later = BUSINESS + timedelta(minutes=5)
    events = frame(spark, event(transaction_id=one, amount="2", ingest_ts=later), event(transaction_id=one, amount="1"),
                   event(transaction_id=one, amount="3", ingest_ts=later), event())
    new, repeats = ingest.dedupe(ingest.normalise_events(events))
    got = {r["transaction_id"]: r for r in new.collect()}
    assert len(got) == 2 and got[one]["amount"] == 1
    assert [tuple(r) for r in repeats.collect()] == [(one, 2)]


def test_known_ids_are_repeats(spark):
    one = str(uuid.uuid4())
    events = ingest.normalise_events(frame(spark, event(transaction_id=one), event()))
    new, repeats = ingest.dedupe(events, known=events.where(events.transaction_id == one))
    assert new.count() == 1 and new.first()["transaction_id"] != one
    assert [tuple(r) for r in repeats.collect()] == [(one, 1)]


def test_missing_ids(spark):
    given = str(uuid.uuid4())
    events = frame(spark, event(transaction_id=given), event(transaction_id=None), event(transaction_id=""))
    random_ids = [r[0] for r in ingest.assign_missing_ids(events).select("transaction_id").collect()]
    assert random_ids[0] == given and len(set(random_ids)) == 3 and all(uuid.UUID(i) for i in random_ids)
    first, second = (ingest.assign_missing_ids(events, ["customer_id", "amount"]).select("transaction_id").collect()
                     for _ in range(2))
    assert first == second and uuid.UUID(first[1][0])
