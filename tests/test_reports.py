from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import BUSINESS, OFF_HOURS, frame, merchants, txn
from swipewatch.functions.columns import percentage
from swipewatch.operators import outcomes, reports
from swipewatch.plans.assess import assess
from swipewatch.schemas import OUTCOME_REQUEST
from swipewatch.sources import tables

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def txns(spark):
    return frame(spark, [
        txn(BUSINESS, customer="A", merchant="X", category="CRYPTO"),
        txn(OFF_HOURS + DAY, customer="A", merchant="X", category="CRYPTO"),
        txn(OFF_HOURS + 2 * DAY, customer="A", merchant="Y"),
        txn(BUSINESS + 3 * DAY, customer="B", merchant="X"),
        txn(OFF_HOURS + 4 * DAY, customer="B", merchant="X", category="GAMBLING"),
    ])


@pytest.fixture(scope="module")
def assessed(spark, txns):
    return assess(txns, merchants(spark)).cache()


def test_percentage_rounds_halves_up(spark):
    rows = spark.createDataFrame([(1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (0, 5, 0.0), (3, 0, 0.0), (5, 5, 100.0)],
                                 "part long, whole long, want double")
    for got, want in rows.select(percentage(F.col("part"), F.col("whole")), "want").collect():
        assert got == want


def test_fraud_summary(assessed):
    row = reports.fraud_summary(assessed).first()
    assert (row["total_assessed"], row["total_flagged"], row["total_not_flagged"], row["fraud_rate"]) == (5, 2, 3, 40.0)
    assert [tuple(r) for r in row["rule_breakdown"]] == [
        ("HIGH_RISK_MERCHANT_CATEGORY", 2, 100.0), ("TIME_OF_DAY_ANOMALY", 1, 50.0)]
    assert [tuple(r) for r in reports.rule_breakdown(assessed).collect()] == [tuple(r) for r in row["rule_breakdown"]]


def test_empty_range(assessed):
    row = reports.fraud_summary(assessed, BUSINESS + 30 * DAY).first()
    assert tuple(row) == (0, 0, 0, 0.0, [])


def test_customer_summary(txns, assessed):
    rows = {r["customer_id"]: r for r in reports.risk_summary(txns, assessed).collect()}
    a = rows["A"]
    assert (a["total_transactions"], a["flagged_count"], a["not_flagged_count"], a["fraud_rate"]) == (3, 2, 1, 66.67)
    assert a["most_triggered_rules"] == ["HIGH_RISK_MERCHANT_CATEGORY", "TIME_OF_DAY_ANOMALY"]
    assert rows["B"]["flagged_count"] == 0 and rows["B"]["highest_risk_score"] == 13


def test_since_limits_counts_but_not_first_and_last(txns, assessed):
    row = reports.risk_summary(txns, assessed, since=BUSINESS + 30 * DAY).where("customer_id = 'A'").first()
    assert (row["total_transactions"], row["flagged_count"], row["highest_risk_score"], row["fraud_rate"]) == (0, 0, 0, 0.0)
    assert row["most_triggered_rules"] == [] and row["first_transaction_at"] < row["last_transaction_at"]


def test_merchant_summary(txns, assessed):
    rows = {r["merchant_id"]: r for r in reports.risk_summary(txns, assessed, "merchant_id").collect()}
    assert rows["X"]["unique_customers"] == 2 and rows["Y"]["unique_customers"] == 1
    assert rows["X"]["total_transactions"] == 4
    with pytest.raises(ValueError):
        reports.risk_summary(txns, assessed, "currency")


def test_approximate_customers_agree_when_few(txns):
    exact = reports.unique_customers(txns).orderBy("merchant_id").collect()
    assert reports.unique_customers(txns, approximate=True).orderBy("merchant_id").collect() == exact


def test_coverage_lists_silent_rules(assessed):
    rows = {r["rule_name"]: r for r in reports.pattern_coverage(assessed).collect()}
    assert len(rows) == 12 and rows["TIME_OF_DAY_ANOMALY"]["fired"] == 3
    assert not rows["VELOCITY"]["covered"] and rows["VELOCITY"]["config"]["maxTransactions"] == "5"


def test_detection_metrics_are_null_without_labels(assessed):
    row = reports.detection_metrics(assessed).first()
    assert (row["tp"], row["fn"], row["fp"], row["tn"]) == (0, 0, 0, 0) and row["f1"] is None


# --- outcomes -------------------------------------------------------------------------------------

def request(event, target, outcome, minutes):
    return (event, target, outcome, BUSINESS + timedelta(minutes=minutes))


def test_first_writer_wins(spark, assessed):
    ids = [r["transaction_id"] for r in assessed.orderBy("assessed_at").collect()]
    requests = spark.createDataFrame([
        request("e2", ids[0], "FALSE_POSITIVE", 2), request("e1", ids[0], "CONFIRMED_FRAUD", 1),
        request("e3", ids[0], "UNRESOLVED", 0), request("e4", ids[1], "UNRESOLVED", 0), request("e5", ids[1], None, 0),
        request("e6", "missing", "CONFIRMED_FRAUD", 0), request("e7", ids[2], "SOMETHING", 0),
        request("b", ids[3], "FALSE_POSITIVE", 5), request("a", ids[3], "CONFIRMED_FRAUD", 5),
    ], OUTCOME_REQUEST)
    updated, statuses = outcomes.resolve_outcomes(assessed, requests)
    outcome = {r["transaction_id"]: r["outcome"] for r in updated.collect()}
    assert [outcome[i] for i in ids] == ["CONFIRMED_FRAUD", "UNRESOLVED", "UNRESOLVED", "CONFIRMED_FRAUD", "UNRESOLVED"]
    got = {r["event_id"]: (r["status"], r["standing_outcome"]) for r in statuses.collect()}
    assert got == {
        "e1": ("APPLIED", "CONFIRMED_FRAUD"), "e2": ("CONFLICT", "CONFIRMED_FRAUD"), "e3": ("INVALID", None),
        "e4": ("INVALID", None), "e5": ("INVALID", None), "e6": ("NOT_FOUND", None), "e7": ("INVALID", None),
        "a": ("APPLIED", "CONFIRMED_FRAUD"), "b": ("CONFLICT", "CONFIRMED_FRAUD")}

    # A later run never overwrites what stands.
    again, second = outcomes.resolve_outcomes(updated, spark.createDataFrame(
        [request("e9", ids[0], "FALSE_POSITIVE", 9)], OUTCOME_REQUEST))
    assert again.where(F.col("transaction_id") == ids[0]).first()["outcome"] == "CONFIRMED_FRAUD"
    assert tuple(second.select("status", "standing_outcome").first()) == ("CONFLICT", "CONFIRMED_FRAUD")
    metrics = reports.detection_metrics(updated).first()
    assert (metrics["tp"], metrics["fn"]) == (1, 1) and metrics["sensitivity"] == 0.5


def test_the_outcome_log(spark, tmp_path):
    """First writer by log order, repeated batches, compaction; no assessment file is touched."""
    ids = [f"00000000-0000-0000-0000-{i:012d}" for i in range(30)]
    tables.write_assessments(assess(frame(spark, [txn(BUSINESS, id=i) for i in ids]), merchants(spark)), str(tmp_path / "a"))
    assessed = spark.read.parquet(str(tmp_path / "a"))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*") if p.is_file()}
    before, log = files(), str(tmp_path / "log")
    send = lambda *rows: spark.createDataFrame(list(rows), "event_id string, transaction_id string, outcome string, recorded_at timestamp")
    status = lambda frame: {r.event_id: (r.status, r.standing_outcome) for r in frame.collect()}
    first = send(request("1", ids[0], "CONFIRMED_FRAUD", 5), request("2", ids[0], "FALSE_POSITIVE", 4), request("3", ids[1], "NOPE", 1),
                 request("4", "gone", "CONFIRMED_FRAUD", 1), *[request(f"b{i}", ids[i], "FALSE_POSITIVE", i) for i in range(2, 10)])
    for _ in range(2):  # written twice, as after a stop
        got = status(outcomes.record(first, assessed, log, 1))
    assert got["2"] == ("APPLIED", "FALSE_POSITIVE") and got["1"] == ("CONFLICT", "FALSE_POSITIVE")
    assert got["3"] == ("INVALID", None) and got["4"] == ("NOT_FOUND", None) and got["b7"] == ("APPLIED", "FALSE_POSITIVE")
    # sent earlier by its own clock, but the log has a decision already
    second = send(request("5", ids[0], "CONFIRMED_FRAUD", -99), request("6", ids[1], "CONFIRMED_FRAUD", 9))
    got = status(outcomes.record(second, assessed, log, 2))
    assert got == {"5": ("CONFLICT", "FALSE_POSITIVE"), "6": ("APPLIED", "CONFIRMED_FRAUD")}
    assert status(outcomes.record(first, assessed, log, 1))["2"] == ("APPLIED", "FALSE_POSITIVE")  # a repeat decides as it did
    outcomes.compact_log(spark, log, str(tmp_path / "compact"), 2)
    for folder in (log, str(tmp_path / "compact")):
        shown = outcomes.with_outcomes(assessed, outcomes.read_log(spark, folder))
        assert shown.columns == assessed.columns
        assert {r.transaction_id: r.outcome for r in shown.collect()} == {
            i: "CONFIRMED_FRAUD" if n == 1 else "FALSE_POSITIVE" if n < 10 else "UNRESOLVED" for n, i in enumerate(ids)}
    assert files() == before and outcomes.read_log(spark, str(tmp_path / "none")).count() == 0
