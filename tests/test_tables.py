from datetime import date, timedelta

import pytest

from helpers import BUSINESS, OFF_HOURS, frame, merchants, txn
from swipewatch.plans.assess import assess
from swipewatch.operators import feeds
from swipewatch.sources import tables

DAYS = [BUSINESS - timedelta(days=d) for d in (0, 1, 90, 91, 92)]


@pytest.fixture(scope="module")
def txns(spark):
    return frame(spark, [txn(at, customer=f"C-{i}") for at in DAYS for i in range(5)])


def test_daily_partitions_prune(spark, txns, tmp_path):
    path = str(tmp_path / "t")
    tables.write_daily_partitions(txns, path)
    day = DAYS[1].date()
    one = tables.scan_transactions(spark, path, day, day)
    assert one.count() == 5 and one.columns == txns.columns
    assert "PartitionFilters: [isnotnull(event_date" in one._jdf.queryExecution().toString()
    assert sorted(map(str, tables.scan_transactions(spark, path).collect())) == sorted(map(str, txns.collect()))


def test_split_retention(txns):
    active, archived = tables.split_retention(txns, BUSINESS.date())
    assert active.count() == 15 and archived.count() == 10


def test_archive_moves_whole_days(spark, txns, tmp_path):
    table, archive = str(tmp_path / "t"), str(tmp_path / "old")
    tables.write_daily_partitions(txns, table)
    moved = tables.archive_expired(spark, table, archive, BUSINESS.date())
    assert moved == ["2026-04-14", "2026-04-15"]
    assert tables.scan_transactions(spark, table).count() == 15
    assert tables.scan_transactions(spark, archive).count() == 10
    assert tables.archive_expired(spark, table, archive, BUSINESS.date()) == []
    # a day written anew and moved again joins what is there
    tables.write_daily_partitions(txns, table)
    assert tables.archive_expired(spark, table, archive, BUSINESS.date()) == ["2026-04-14", "2026-04-15"]
    assert tables.scan_transactions(spark, archive).count() == 20
    assert sorted(p.name for p in (tmp_path / "old").iterdir()) == ["event_date=2026-04-14", "event_date=2026-04-15"]


def test_routes_are_disjoint_and_complete(spark):
    rows = [txn(BUSINESS, category=c, customer=c) for c in ("CRYPTO", "RETAIL")] + [txn(OFF_HOURS, category="CASINO", kind=None)]
    assessed = assess(frame(spark, rows), merchants(spark))
    routed = tables.route(assessed)
    assert {name: part.count() for name, part in routed.items()} == {"FLAGGED": 1, "PENDING_REVIEW": 1, "CLEARED": 1}
    assert routed["FLAGGED"].columns == ["transaction_id", "customer_id", "risk_score", "assessed_at"]
    pending = routed["PENDING_REVIEW"].first()
    assert pending["amount"] == "100.0000" and pending["transaction_type"] == "CARD_NOT_PRESENT"
    assert "risk_score" not in routed["CLEARED"].columns


def test_assessments_are_stored_by_verdict(spark, tmp_path):
    assessed = assess(frame(spark, [txn(category="CRYPTO"), txn(customer="D")]), merchants(spark))
    path = str(tmp_path / "a")
    tables.write_assessments(assessed, path)
    back = tables.read_assessments(spark, path, assessed.schema)
    assert back.where("disposition = 'FLAGGED'").count() == 1
    assert tables.explode_violations(back).select("rule_name", "position").collect()[0] == ("HIGH_RISK_MERCHANT_CATEGORY", 0)


class Session:
    """Just enough of a session to ask for the shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf = self
        self.master, self.folder, self.applicationId = master, folder, "app-1"

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self.folder, "spark.sql.warehouse.dir": "file:/warehouse"}.get(key) or default


def test_shared_folder_comes_from_the_session(spark):
    assert tables.shared_folder(Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session("yarn"))
    assert tables.shared_folder(Session("local[2]")) == "file:/warehouse/scratch"


def test_dates():
    assert tables.RETENTION_DAYS == 91 and date(2024, 4, 14) - timedelta(days=91) == date(2024, 1, 14)


def test_a_lookup_skips_row_groups(spark, tmp_path):
    """Forty files of ids in no order: without Bloom filters every one of them would be read."""
    rows = frame(spark, [txn(BUSINESS, customer=f"C-{i}") for i in range(2000)]).repartition(40)
    tables.write_assessments(assess(rows, merchants(spark)).repartition(40), str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    wanted = rows.first()["transaction_id"]
    found = feeds.lookup(stored, wanted)
    assert found.count() == 1

    def scanned(frame):
        plan = frame._jdf.queryExecution()
        plan.executedPlan().executeCollect()
        node = plan.executedPlan()
        while "Scan" not in node.nodeName():
            node = node.inputPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.children().apply(0)
        return node.metrics().apply("numOutputRows").value()

    assert scanned(found) < 200 and scanned(stored.where("risk_score >= 0")) == 2000
