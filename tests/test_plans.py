"""The shape of physical plans: what is shuffled, pruned and kept out of Python."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import BUSINESS, frame, merchants, txn
from swipewatch.operators import feeds, reports
from swipewatch.operators.context import build_context
from swipewatch.plans.assess import assess
from swipewatch.schemas import TRANSACTION
from swipewatch.sources import demo, tables


def plan(result):
    return result._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    rows = frame(spark, [txn(BUSINESS, customer=f"C-{i}") for i in range(20)])
    rows.write.parquet(f"{folder}/txns")
    tables.write_assessments(assess(rows, merchants(spark)), f"{folder}/assessed")
    return (spark.read.schema(TRANSACTION).parquet(f"{folder}/txns"), spark.read.parquet(f"{folder}/assessed"))


def test_assess_shuffles_once(spark, stored):
    text = plan(assess(stored[0], demo.merchants(spark)))
    assert len(re.findall(r"\bExchange hashpartitioning", text)) == 1
    assert "BroadcastHashJoin" in text and "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_hot_path_has_no_cross_joins_and_python_for_travel_alone(spark, stored):
    from swipewatch.config import SkewConfig
    text = plan(assess(stored[0], demo.merchants(spark), skew=SkewConfig(hot_rows=1)))
    assert "Cartesian" not in text and "NestedLoop" not in text and "EvalPython" not in text
    assert len(re.findall(r"FlatMapGroupsInArrow customer_id#", text)) <= 1 and text.count("FlatMapGroupsInArrow") <= 2
    # Windows over a hot customer's events are always cut into blocks.
    specs = [spec for spec in re.findall(r"windowspecdefinition\((.*?) ASC", text) if re.search(r"\bat#\d+L?$", spec)]
    assert specs and all("block#" in spec for spec in specs)


def test_hot_path_deals_events_out_once_and_walks_many_slabs_at_once(spark, stored):
    from swipewatch.config import SkewConfig
    text = plan(assess(stored[0], demo.merchants(spark), skew=SkewConfig(hot_rows=1)))
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id#\d+, block#\d+, \d+\), REPARTITION", text)) == 1
    assert "SortMergeJoin [customer_id" not in text.replace("LeftAnti", "")  # sums of earlier stretches are rows, not joined
    assert "FlatMapGroupsInArrow" not in text and "MapInArrow" in text


@pytest.mark.parametrize("skew", [None, 1], ids=["ordinary", "hot"])
def test_number_of_tasks_follows_the_rows(spark, stored, monkeypatch, skew):
    from swipewatch.config import SkewConfig
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 2)
    context = build_context(stored[0], demo.merchants(spark), skew=SkewConfig(hot_rows=skew or 200_000))
    asked = [int(n) for n in re.findall(r"Exchange hashpartitioning\(customer_id#\d+[^)]*, (\d+)\), REPARTITION_BY_NUM", plan(context))]
    assert asked and min(asked) >= 10 and context.count() == 20


def test_unused_context_leaves_the_plan(spark, stored):
    context = build_context(stored[0], demo.merchants(spark)).select("transaction_id", "daily_spend")
    text = plan(context)
    assert "collect_list" not in text and text.count("try_sum") == 0


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(reports.disposition_counts(stored[1].where(F.col("assessed_at") >= F.lit(BUSINESS))))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(assessed_at", text)
    assert re.search(r"ReadSchema: struct<assessed_at:timestamp>", text)


def test_feeds_prune_partitions_and_keep_the_best_rows_only(stored):
    text = plan(feeds.feed(stored[1], "FLAGGED", min_score=60))
    assert re.search(r"PartitionFilters: \[.*disposition#\d+ = FLAGGED", text)
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(risk_score,60)" in text


def test_rule_filter_needs_no_join(stored):
    assert "Join" not in plan(feeds.where_all(stored[1], feeds.broke_rule("VELOCITY")))


def test_summaries_aggregate_before_shuffling(stored):
    text = plan(reports.risk_summary(stored[0], stored[1]))
    assert "partial_count" in text or "partial_count_if" in text or "partial_max" in text


@pytest.mark.parametrize("by", ["customer_id", "merchant_id"])
def test_summaries_read_each_table_once(stored, by):
    assert plan(reports.risk_summary(stored[0], stored[1], by)).count("FileScan") == 2
