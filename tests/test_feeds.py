import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import BUSINESS, OFF_HOURS, frame, merchants, txn
from swipewatch.functions.cursor import cursor_text, decode_cursor, encode_cursor
from swipewatch.operators import feeds
from swipewatch.plans.assess import assess


@pytest.fixture(scope="module")
def txns(spark):
    # Every third row shares its time with its neighbours, so ties decide the order.
    rows = [txn(BUSINESS + timedelta(hours=i // 3), category="CRYPTO", customer=f"C-{i % 4}", merchant=f"M-{i % 3}",
                amount=str(100 + i)) for i in range(47)]
    rows += [txn(OFF_HOURS + timedelta(days=i), customer="C-0") for i in range(1, 4)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def assessed(spark, txns):
    return assess(txns, merchants(spark)).cache()


def test_cursor_round_trip(spark):
    moments = [datetime(2026, 7, 15, 10, 0, 0, f, tzinfo=timezone.utc) for f in (0, 120_000, 123_456, 7)]
    ids = [str(uuid.uuid4()) for _ in moments]
    rows = spark.createDataFrame(list(zip(moments, ids)), "at timestamp, id string")
    for at, row_id, text in rows.select("at", "id", encode_cursor(F.unix_micros("at"), F.col("id"))).collect():
        assert "=" not in text and "\n" not in text
        moment, decoded = decode_cursor(text)
        assert (moment, decoded) in zip(moments, ids) and decoded == row_id
        assert cursor_text(moment, row_id) == text


@pytest.mark.parametrize("text", ["", "%%%", "abc", "bm8tc2VwYXJhdG9y", "MjAyNi0wNy0xNVQxMDowMDowMFp8bm90LWEtdXVpZA"])
def test_malformed_cursor(text):
    with pytest.raises(ValueError, match="Invalid or malformed cursor"):
        decode_cursor(text)


@pytest.mark.parametrize("sort", ["asc", "desc"])
def test_following_cursors_visits_every_row_once(assessed, sort):
    seen, cursor, pages = [], None, 0
    while True:
        rows = feeds.feed(assessed, "FLAGGED", cursor=cursor, page_size=10, sort=sort).orderBy("position").collect()
        seen += [(r["assessed_at"], r["assessment_id"]) for r in rows]
        pages += 1
        if not rows[0]["has_more"]:
            assert rows[0]["next_cursor"] is None
            break
        cursor = rows[0]["next_cursor"]
    assert pages == 5 and len(seen) == 47
    assert seen == sorted(seen, reverse=sort == "desc")


def test_all_pages_at_once(assessed):
    flagged = assessed.where("disposition = 'FLAGGED'")
    got = feeds.feed_pages(flagged, "assessed_at", "assessment_id", page_size=10).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 48))
    assert [r["page"] for r in got] == [n // 10 + 1 for n in range(47)]
    order = [(r["assessed_at"], r["assessment_id"]) for r in got]
    assert order == sorted(order, reverse=True)


def test_filters_combine(assessed):
    page = feeds.feed(assessed, "FLAGGED", customer_id="C-1", merchant_id="M-1", rule="HIGH_RISK_MERCHANT_CATEGORY",
                      min_score=57, max_score=57, from_=BUSINESS, to=BUSINESS + timedelta(hours=12))
    rows = page.collect()
    assert rows and all(r["customer_id"] == "C-1" and r["merchant_id"] == "M-1" and r["risk_score"] == 57 for r in rows)


def test_range_ends_are_inclusive(assessed):
    assert feeds.feed(assessed, "FLAGGED", from_=BUSINESS, to=BUSINESS).count() == 3


def test_bad_arguments(assessed):
    with pytest.raises(ValueError, match="must not be before"):
        feeds.feed(assessed, "FLAGGED", from_=BUSINESS, to=BUSINESS - timedelta(seconds=1))
    with pytest.raises(ValueError, match="unknown rule"):
        feeds.feed(assessed, "FLAGGED", rule="NOPE")
    with pytest.raises(ValueError, match="unknown disposition"):
        feeds.feed(assessed, "LOST")
    for size in (0, 1001):
        with pytest.raises(ValueError, match="page size"):
            feeds.feed(assessed, "FLAGGED", page_size=size)
    with pytest.raises(ValueError, match="cleared feed"):
        feeds.feed(assessed, "CLEARED", max_score=5)


def test_default_page_is_twenty(assessed):
    assert feeds.feed(assessed, "FLAGGED").count() == 20


def test_history_shows_unassessed_transactions(spark, txns, assessed):
    some = assessed.where("merchant_id <> 'M-0'")
    rows = feeds.customer_history(txns, some, "C-0", page_size=100).collect()
    assert {r["assessment"] is None for r in rows} == {True, False}
    assert len(rows) == txns.where("customer_id = 'C-0'").count()


def test_empty_page(assessed):
    assert feeds.feed(assessed, "FLAGGED", customer_id="nobody").collect() == []


def test_lookup_ignores_case(txns):
    one = txns.first()["transaction_id"]
    assert feeds.lookup(txns, one.upper()).count() == 1


def test_one_moment_is_numbered_by_many_tasks(spark):
    """A feed all of whose rows share one time: ranges go by id as well."""
    rows = spark.range(5000).select(F.lit(BUSINESS).alias("assessed_at"), F.format_string("id-%05d", "id").alias("assessment_id"))
    pages = feeds.feed_pages(rows, "assessed_at", "assessment_id", page_size=7, parts=8)
    sizes = [spark.read.parquet(file).count() for file in set(pages.inputFiles())]
    assert len(sizes) == 8 and max(sizes) < 2000
    got = pages.orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 5001)) and [r["page"] for r in got] == [n // 7 + 1 for n in range(5000)]
    assert [r["assessment_id"] for r in got] == [f"id-{i:05d}" for i in range(4999, -1, -1)]
    assert feeds.feed_pages(rows.limit(0), "assessed_at", "assessment_id").count() == 0
