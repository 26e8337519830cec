"""Scoring from stored bucket tables against scoring with the whole history."""

import re
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import BUSINESS, frame, merchants, txn
from swipewatch.config import RuleConfig, SkewConfig
from swipewatch.operators import buckets
from swipewatch.plans.assess import assess, assess_from_buckets
from test_replay import PLACES, history

CFG = RuleConfig(baseline_days=3)


def results(frame):
    rows = {r.transaction_id: (r.risk_score, r.disposition, r.violations) for r in frame.collect()}
    return rows


@pytest.fixture(scope="module")
def rows():
    return history(seed=11, rows=300)


@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(hot_rows=40, block_rows=40)], ids=["ordinary", "mixed"])
@pytest.mark.parametrize("cut", [timedelta(hours=1), timedelta(days=3, minutes=40)], ids=["first day", "fourth day"])
def test_same_as_the_whole_history(spark, tmp_path, rows, skew, cut):
    places = merchants(spark, [(m, *place, None, None) for m, place in PLACES.items()])
    at = BUSINESS + cut
    old, new = frame(spark, [r for r in rows if r[10] < at]), frame(spark, [r for r in rows if r[10] >= at])
    wanted = results(assess(new, places, CFG, mode="bucketed", history=old, skew=skew))
    for i in range(3):  # three deliveries of the same days, one of them written twice
        for _ in range(1 + (i == 1)):
            buckets.add_deltas(old.where(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == i), f"{tmp_path}/tables", f"b{i}")
    # what the tables stand for is gone: of the raw history only the running day and the lookback are left
    start = at.replace(hour=0, minute=0)
    latest = old.where(F.col("timestamp") >= F.lit(min(start, at - timedelta(minutes=CFG.lookback_minutes))))
    found = assess_from_buckets(new, places, latest, *buckets.read_deltas(spark, f"{tmp_path}/tables"), rule_cfg=CFG, skew=skew)
    assert results(found) == wanted and len(wanted) > 20
    buckets.compact(spark, f"{tmp_path}/tables", f"{tmp_path}/compacted")
    again = assess_from_buckets(new, places, latest, *buckets.read_deltas(spark, f"{tmp_path}/compacted"), rule_cfg=CFG, skew=skew)
    assert results(again) == wanted


def test_deltas_merge(spark, rows):
    every = frame(spark, rows)
    parts = [every.where(F.pmod(F.xxhash64("transaction_id"), F.lit(4)) == i) for i in range(4)]
    hourly, daily = buckets.hourly_delta(parts[0]), buckets.daily_delta(parts[0])
    for part in parts[1:]:
        hourly, daily = hourly.unionByName(buckets.hourly_delta(part)), daily.unionByName(buckets.daily_delta(part))
    for one, all_at_once in zip(buckets.merged(hourly, daily), (buckets.hourly_delta(every), buckets.daily_delta(every))):
        names = [c for c in all_at_once.columns if c != "rough"]
        assert sorted(map(repr, one.select(*names).collect())) == sorted(map(repr, all_at_once.select(*names).collect()))


def test_old_days_and_old_rows_are_not_read(spark, tmp_path, rows):
    every = frame(spark, rows)
    at = BUSINESS + timedelta(days=2)
    every.write.parquet(f"{tmp_path}/txns")
    buckets.add_deltas(every.where(F.col("timestamp") < F.lit(at)), f"{tmp_path}/tables", "b")
    stored = spark.read.schema(every.schema).parquet(f"{tmp_path}/txns")
    new = stored.where(F.col("timestamp") >= F.lit(at))
    result = assess_from_buckets(new, merchants(spark), stored.where(F.col("timestamp") < F.lit(at)),
                                 *buckets.read_deltas(spark, f"{tmp_path}/tables"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # filters in full
    plan = result._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    # every scan of transactions begins at the running day (history) or at the first new row
    since = re.findall(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(timestamp,([^)]*)\)", plan)
    assert set(since) == {"2026-07-17 00:00:00.0", "2026-07-17 10:00:00.0"} and plan.count("ReadSchema: struct<transaction_id") >= 2
    assert len(re.findall(r"PartitionFilters: \[[^\]]*epoch_day#\d+L? >", plan)) == 2


def test_no_transactions_and_no_tables(spark):
    empty = frame(spark, [])
    hourly, daily = (spark.createDataFrame([], kind) for kind in (buckets.HOURLY, buckets.DAILY))
    assert assess_from_buckets(empty, merchants(spark), empty, hourly, daily).count() == 0
    new = frame(spark, [txn(BUSINESS)])
    assert results(assess_from_buckets(new, merchants(spark), empty, hourly, daily)) == results(assess(new, merchants(spark)))


def test_squares_beyond_the_widest_decimal(spark):
    big = Decimal("999999999999999.9999")
    old = [txn(BUSINESS - timedelta(days=1, minutes=i), str(big if i % 2 else big - 1000), customer="C") for i in range(40)]
    new = frame(spark, [txn(BUSINESS, "100", customer="C")])
    hourly, daily = buckets.hourly_delta(frame(spark, old)), buckets.daily_delta(frame(spark, old))
    wanted = assess(new, merchants(spark), mode="bucketed", history=frame(spark, old))
    found = assess_from_buckets(new, merchants(spark), frame(spark, []), hourly, daily)
    assert results(found) == results(wanted)
