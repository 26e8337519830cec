import json
import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BUSINESS, CAPE_TOWN, LONDON, ago, frame, merchants, txn
from swipewatch.operators.context import BUCKETED
from swipewatch.plans.assess import assess
from swipewatch.sources import ingest, tables
from swipewatch.streaming import commits, metrics
from swipewatch.streaming.activity import Totals
from swipewatch.streaming.metrics import BatchTimes
from swipewatch.streaming.run import as_raw_events, start_quarantine, start_scoring
from test_replay import history


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of the state starts its own Python worker per micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, folder, rows, **options):
    """Delivers rows and runs the stream until it has taken them."""
    as_raw_events(frame(spark, rows)).write.mode("append").parquet(f"{folder}/inbox")
    raw = tables.stream_transactions(spark, f"{folder}/inbox")
    start_scoring(raw, options.pop("load", lambda: merchants(spark)), folder, assessed_at=F.col("timestamp"),
                  **options).awaitTermination()
    return spark.read.parquet(f"{folder}/assessments")


def names(row):
    return [v["rule_name"] for v in row["violations"]]


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rows = sorted(history(seed=3, rows=120), key=lambda r: (r[10], r[0]))
    places = merchants(spark, [("M-0", *LONDON, None, None), ("M-1", *CAPE_TOWN, None, None)])
    # Wire ids are UUIDs; keep the order of the originals.
    rows = [(f"00000000-0000-0000-0000-{i:012d}", *row[1:]) for i, row in enumerate(rows)]
    for part in (rows[:50], rows[50:]):
        got = feed(spark, str(tmp_path), part, load=lambda: places)
    clean = ingest.normalise_events(as_raw_events(frame(spark, rows)))
    want = assess(clean, places, mode=BUCKETED)
    columns = ["transaction_id", "risk_score", "disposition", "violations"]
    found = {r["transaction_id"]: r for r in got.select(*columns).collect()}
    assert len(found) == got.count() == 120
    for row in want.select(*columns).collect():
        assert found[row["transaction_id"]] == row
    routed = [spark.read.parquet(f"{tmp_path}/routed/{v}").count() for v in ("flagged", "pending_review", "cleared")]
    assert sum(routed) == 120


def test_redelivery_is_ignored_and_late_rows_are_kept(spark, tmp_path):
    folder = str(tmp_path)
    first = txn(ago(BUSINESS, minutes=1), "149.99")
    feed(spark, folder, [first])
    feed(spark, folder, [first])
    late = txn(ago(BUSINESS, minutes=30), "80", merchant="L", place=CAPE_TOWN)
    got = feed(spark, folder, [late])
    assert got.count() == 2
    twin = txn(BUSINESS, "149.99", place=LONDON)
    rows = {r["transaction_id"]: r for r in feed(spark, folder, [twin]).collect()}
    # Exactly one duplicate was remembered, and the late row counts as history.
    assert set(names(rows[twin[0]])) == {"DUPLICATE_TRANSACTION", "GEOGRAPHIC_ANOMALY"}


def test_bad_and_future_events_go_to_quarantine(spark, tmp_path):
    folder = str(tmp_path)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    good = dict(transaction_id="00000000-0000-0000-0000-000000000001", customer_id="C", merchant_id="M", amount="5",
                currency="ZAR", category="", location="", latitude=0.0, longitude=0.0, device_fingerprint="",
                timestamp="2026-07-15T10:00:00Z", transaction_type="ATM", ingest_ts="2026-07-15T10:00:01Z")
    lines = [good, {**good, "transaction_id": "x"}, {**good, "amount": "?"}, {**good, "currency": "TOOLONG"},
             {**good, "transaction_id": "00000000-0000-0000-0000-000000000002", "timestamp": "2027-07-15T10:00:00Z"}]
    (inbox / "a.json").write_text("\n".join([json.dumps(x) for x in lines] + ["not json"]) + "\n")
    raw = tables.stream_transactions(spark, str(inbox), "json")
    start_quarantine(raw, folder, max_future_skew="1 day").awaitTermination()
    start_scoring(raw, lambda: merchants(spark), folder, max_future_skew="1 day").awaitTermination()
    reasons = [r["reason"] for r in spark.read.parquet(f"{folder}/quarantine").collect()]
    assert len(reasons) == 5 and "timestamp: too far in the future" in reasons
    assert any(r.startswith("transaction_id: not a UUID; amount:") for r in reasons)
    assert spark.read.parquet(f"{folder}/assessments").count() == 1


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    folder = str(tmp_path)
    rows = [txn(BUSINESS + timedelta(seconds=i), str(i + 1)) for i in range(4)]
    feed(spark, folder, rows[:2])
    done = sorted((tmp_path / "checkpoints" / "scoring" / "commits").glob("[0-9]*"))
    done[-1].unlink()  # as if the driver had died before noting the batch as finished
    (done[-1].parent / f".{done[-1].name}.crc").unlink(missing_ok=True)
    got = feed(spark, folder, rows[2:])
    assert got.count() == 4 and got.select("transaction_id").distinct().count() == 4


def test_old_redeliveries_count_once(spark, tmp_path):
    rows = [txn(BUSINESS + timedelta(hours=5 * i), "10") for i in range(12)]
    feed(spark, str(tmp_path), rows)
    last = txn(BUSINESS + timedelta(hours=56), "10")
    got = feed(spark, str(tmp_path), [*rows[:3], *rows[:3], last])
    assert got.count() == 13 and got.select("transaction_id").distinct().count() == 13


def test_large_equal_amounts_have_no_deviation(spark, tmp_path):
    rows = [txn(ago(BUSINESS, days=i), "12345678901.0007", id=f"00000000-0000-0000-0000-{99 - i:012d}") for i in range(20)]
    got = {r["transaction_id"]: r for r in feed(spark, str(tmp_path), rows).collect()}
    want = assess(ingest.normalise_events(as_raw_events(frame(spark, rows))), merchants(spark), mode=BUCKETED)
    for row in want.select("transaction_id", "risk_score", "violations").collect():
        found = got[row["transaction_id"]]
        assert (found["risk_score"], found["violations"]) == (row["risk_score"], row["violations"])
        assert "CUSTOMER_AMOUNT_ANOMALY" not in names(row)


def test_batch_times(spark, tmp_path):
    listener = BatchTimes()
    spark.streams.addListener(listener)
    try:
        feed(spark, str(tmp_path), [txn(BUSINESS)])
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    row = listener.percentiles(spark).first()
    assert row["query"] == "scoring" and row["input_rows"] == 1 and row["p50_millis"] > 0


def test_outputs_of_a_batch_appear_together(spark, tmp_path, monkeypatch):
    """A stop after the last write and before the commit: nothing of the batch shows, and the next run brings it once."""
    folder = str(tmp_path)
    feed(spark, folder, [txn(BUSINESS, "1")])
    assert commits.read_output(spark, folder, "assessments").count() == 1

    def stop(*args):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(commits, "commit", stop)
        with pytest.raises(Exception, match="stopped"):
            feed(spark, folder, [txn(BUSINESS + timedelta(minutes=5), "2")])
    count = lambda name: commits.read_output(spark, folder, name).count()
    assert spark.read.parquet(f"{folder}/assessments").count() == 2  # written, but not part of any commit
    assert count("assessments") == 1 and sum(count(f"routed/{v}") for v in ("flagged", "pending_review", "cleared")) == 1
    feed(spark, folder, [txn(BUSINESS + timedelta(minutes=9), "3")])
    assert count("assessments") == 3 and sum(count(f"routed/{v}") for v in ("flagged", "pending_review", "cleared")) == 3
    counted = metrics.merged(commits.read_output(spark, folder, "metrics")).where("metric = 'assessments'")
    assert counted.agg(F.sum("value")).first()[0] == 3


def test_an_id_counts_once_over_customers_and_within_a_batch(spark, tmp_path):
    counters = metrics.StreamCounters()
    spark.streams.addListener(counters)
    try:
        one, two = txn(BUSINESS, customer="A"), txn(BUSINESS + timedelta(minutes=1), customer="A")
        feed(spark, str(tmp_path), [one, one, two])
        got = feed(spark, str(tmp_path), [(one[0], "B", *one[2:]), (two[0], "C", *two[2:]), txn(BUSINESS, customer="B")])
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counters)
    assert sorted(r.customer_id for r in got.collect()) == ["A", "A", "B"]
    assert {r.metric: r.value for r in counters.rows(spark).collect()} == {"arrived": 6, "dead_letters": 0, "duplicate_deliveries": 3}


def test_latency_quantiles(spark):
    rng = random.Random(4)
    millis = sorted(int(rng.lognormvariate(6, 2)) + 1 for _ in range(5000))
    rows = spark.createDataFrame([(m, "CLEARED") for m in millis], "ms long, disposition string").selectExpr(
        "timestamp_micros(0) AS timestamp", "timestamp_micros(ms * 1000) AS assessed_at", "disposition",
        "array(named_struct('rule_name', 'VELOCITY')) AS violations", "array('X') AS rule_errors")
    parts = [metrics.batch_metrics(part) for part in rows.randomSplit([0.2, 0.5, 0.3], seed=1)]
    merged = metrics.merged(parts[0].unionAll(parts[1]).unionAll(parts[2]))
    found = {r.quantile: r.millis for r in metrics.latency_quantiles(merged).collect()}
    for q, value in found.items():
        exact = millis[math.ceil(q * len(millis)) - 1]
        assert exact <= value * (1 + 1e-9) and value <= exact * 1.01 * (1 + 1e-9)
    assert len(found) == 3 and merged.count() < 1500
    counts = {(r.metric, r.tag): r.value for r in merged.where("metric <> 'latency_class'").collect()}
    assert counts == {("assessments", "CLEARED"): 5000, ("violations", "VELOCITY"): 5000, ("rule_errors", "X"): 5000}


def test_totals_equal_plain_sums():
    """Times that go back and forth, expiry, several currencies."""
    rng = random.Random(9)
    totals, plain, now = Totals({(k, "A"): (k,) for k in range(5)}, 6, (0,)), {(k, "A"): k for k in range(5)}, 5
    for _ in range(3000):
        now = max(0, now + rng.choice([0, 0, 0, 1, 1, -2, 9]))
        currency = rng.choice("AB")
        assert totals.as_of(now, currency) == (sum(v for (t, c), v in plain.items() if c == currency and t > now - 6),)
        totals.expire(now)
        plain = {k: v for k, v in plain.items() if k in totals.buckets}
        value = rng.randrange(100)
        totals.add(now, currency, (value,))
        plain[now, currency] = plain.get((now, currency), 0) + value
