"""Counts and risk summaries. Every report is one or two combining aggregates over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipewatch.functions.columns import percentage
from swipewatch.operators.feeds import time_range, where_all
from swipewatch.operators.rules import catalogue
from swipewatch.schemas import CONFIRMED_FRAUD, FALSE_POSITIVE, FLAGGED

TOP_RULES = 3  # fixed value


def _flagged() -> Column:
    return F.col("disposition") == FLAGGED


def _since(column: str, since: datetime | None) -> Column:
    return F.lit(True) if since is None else F.col(column) >= F.lit(since)


# --- global ---------------------------------------------------------------------------------------

def assessed_totals(assessments: DataFrame, from_: datetime | None = None, to: datetime | None = None) -> DataFrame:
    return where_all(assessments, time_range("assessed_at", from_, to)).agg(
        F.count(F.lit(1)).alias("total_assessed"), F.count_if(_flagged()).alias("total_flagged"))


def rule_breakdown(assessments: DataFrame, from_: datetime | None = None, to: datetime | None = None) -> DataFrame:
    """Flagged assessments per rule and their share of all flagged ones, most frequent first.

    Counting assessments that broke a rule needs no distinct: the rule names
    of one row are made unique before they are unnested.
    """
    flagged = where_all(assessments, time_range("assessed_at", from_, to)).where(_flagged())
    counts = (flagged.select(F.explode(F.array_distinct("violations.rule_name")).alias("rule_name"))
              .groupBy("rule_name").agg(F.count(F.lit(1)).alias("flagged_count")))
    total = flagged.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (counts.withColumn("percentage", percentage(F.col("flagged_count"), total))
            .orderBy(F.col("flagged_count").desc(), "rule_name"))


def fraud_summary(assessments: DataFrame, from_: datetime | None = None, to: datetime | None = None) -> DataFrame:
    """One row: totals, rate and the breakdown nested. A single scan: totals ride along with the rule counts."""
    chosen = where_all(assessments, time_range("assessed_at", from_, to))
    # Each assessment contributes one row without a rule and, if flagged, one per rule it broke.
    rules = F.when(_flagged(), F.array_distinct("violations.rule_name")).otherwise(F.expr("cast(array() as array<string>)"))
    per_rule = (chosen.select(_flagged().alias("flagged"), F.explode(F.concat(F.array(F.lit("")), rules)).alias("rule"))
                .groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged")))
    # At most one row per rule is left here, so collecting them is safe.
    whole = per_rule.agg(
        F.coalesce(F.max(F.when(F.col("rule") == "", F.col("n"))), F.lit(0)).alias("total_assessed"),
        F.coalesce(F.max(F.when(F.col("rule") == "", F.col("flagged"))), F.lit(0)).alias("total_flagged"),
        F.collect_list(F.when(F.col("rule") != "", F.struct((-F.col("n")).alias("order"), "rule"))).alias("rules"))
    total, flagged = F.col("total_assessed"), F.col("total_flagged")
    breakdown = F.transform(F.array_sort("rules"), lambda r: F.struct(
        r.rule.alias("rule_name"), (-r.order).alias("flagged_count"), percentage(-r.order, flagged).alias("percentage")))
    return whole.select(total, flagged, (total - flagged).alias("total_not_flagged"),
                        percentage(flagged, total).alias("fraud_rate"), breakdown.alias("rule_breakdown"))


def disposition_counts(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("disposition", "outcome").agg(F.count(F.lit(1)).alias("n"))


# --- per customer or merchant ---------------------------------------------------------------------

def txn_count(txns: DataFrame, by: str, since: datetime | None = None) -> DataFrame:
    return txns.groupBy(by).agg(F.count_if(_since("timestamp", since)).alias("total_transactions"))


def flagged_count(assessments: DataFrame, by: str, since: datetime | None = None) -> DataFrame:
    return assessments.groupBy(by).agg(
        F.count_if(_flagged() & _since("assessed_at", since)).alias("flagged_count"))


def max_score(assessments: DataFrame, by: str, since: datetime | None = None) -> DataFrame:
    return assessments.groupBy(by).agg(
        F.coalesce(F.max(F.when(_since("assessed_at", since), F.col("risk_score"))), F.lit(0)).alias("highest_risk_score"))


def rule_counts(assessments: DataFrame, by: str, since: datetime | None = None) -> DataFrame:
    return (assessments.where(_since("assessed_at", since))
            .select(by, F.explode("violations.rule_name").alias("rule_name"))
            .groupBy(by, "rule_name").agg(F.count(F.lit(1)).alias("n")))


def top_rules(assessments: DataFrame, by: str, since: datetime | None = None, k: int = TOP_RULES) -> DataFrame:
    """The ``k`` rules broken most, over all verdicts. Ranks counts, never rows: one row per rule and key."""
    best = Window.partitionBy(by).orderBy(F.col("n").desc(), "rule_name")
    return (rule_counts(assessments, by, since).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k))


def top_k_rules(assessments: DataFrame, k: int = TOP_RULES) -> DataFrame:
    return (assessments.select(F.explode("violations.rule_name").alias("rule_name"))
            .groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "rule_name").limit(k))


def first_last(txns: DataFrame, by: str) -> DataFrame:
    """Always over all time."""
    return txns.groupBy(by).agg(F.min("timestamp").alias("first_transaction_at"),
                                F.max("timestamp").alias("last_transaction_at"))


def unique_customers(txns: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct customers per merchant. Exact counting first reduces to (merchant, customer) pairs,
    so a merchant with most of the rows is still spread over all tasks."""
    if approximate:
        return txns.groupBy("merchant_id").agg(F.approx_count_distinct("customer_id").alias("unique_customers"))
    return (txns.select("merchant_id", "customer_id").distinct()
            .groupBy("merchant_id").agg(F.count(F.lit(1)).alias("unique_customers")))


def risk_summary(txns: DataFrame, assessments: DataFrame, by: str = "customer_id",
                 since: datetime | None = None) -> DataFrame:
    """Summary of every customer or merchant at once; filter the result for one of them.

    Totals go by transaction time, flags and scores by assessment time, first
    and last over all time. Each table is read once and aggregated to one row
    per key before the two are joined: transactions of a merchant by customer
    first, assessments by rule first, so that no key is one task's.
    """
    if by not in ("customer_id", "merchant_id"):
        raise ValueError("by must be 'customer_id' or 'merchant_id'")
    parts = ["merchant_id", "customer_id"] if by == "merchant_id" else [by]
    activity = txns.groupBy(*parts).agg(
        F.count_if(_since("timestamp", since)).alias("total_transactions"),
        F.min("timestamp").alias("first_transaction_at"), F.max("timestamp").alias("last_transaction_at"))
    if by == "merchant_id":
        activity = activity.groupBy(by).agg(
            F.sum("total_transactions").alias("total_transactions"), F.min("first_transaction_at").alias("first_transaction_at"),
            F.max("last_transaction_at").alias("last_transaction_at"), F.count(F.lit(1)).alias("unique_customers"))
    recent = _since("assessed_at", since)
    # Each assessment contributes one row without a rule and one per rule it broke.
    rules = F.when(recent, F.col("violations.rule_name")).otherwise(F.expr("cast(array() as array<string>)"))
    risk = (assessments.select(by, (_flagged() & recent).alias("flagged"), F.when(recent, F.col("risk_score")).alias("score"),
                               F.explode(F.concat(F.array(F.lit("")), rules)).alias("rule"))
            .groupBy(by, "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"), F.max("score").alias("score"))
            # At most one row per rule and key is left here, so collecting them is safe.
            .groupBy(by).agg(
                F.max(F.when(F.col("rule") == "", F.col("flagged"))).alias("flagged_count"),
                F.max(F.when(F.col("rule") == "", F.col("score"))).alias("highest_risk_score"),
                F.slice(F.array_sort(F.collect_list(F.when(F.col("rule") != "", F.struct((-F.col("n")).alias("order"), "rule")))),
                        1, TOP_RULES).alias("ranked")))
    joined = activity.join(risk, by, "left")
    flagged = F.coalesce("flagged_count", F.lit(0))
    return joined.select(
        by, "total_transactions", flagged.alias("flagged_count"),
        (F.col("total_transactions") - flagged).alias("not_flagged_count"),
        percentage(flagged, F.col("total_transactions")).alias("fraud_rate"),
        F.coalesce("highest_risk_score", F.lit(0)).alias("highest_risk_score"),
        *(["unique_customers"] if by == "merchant_id" else []),
        F.coalesce(F.col("ranked.rule"), F.expr("cast(array() as array<string>)")).alias("most_triggered_rules"),
        "first_transaction_at", "last_transaction_at")


# --- how well the rules do ------------------------------------------------------------------------

def detection_metrics(assessments: DataFrame) -> DataFrame:
    """Confusion matrix of FLAGGED against resolved outcomes, and the usual rates, NULL where undefined."""
    fraud, legitimate = F.col("outcome") == CONFIRMED_FRAUD, F.col("outcome") == FALSE_POSITIVE
    counts = assessments.agg(
        F.count_if(_flagged() & fraud).alias("tp"), F.count_if(~_flagged() & fraud).alias("fn"),
        F.count_if(_flagged() & legitimate).alias("fp"), F.count_if(~_flagged() & legitimate).alias("tn"))
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    return counts.select(
        "tp", "fn", "fp", "tn",
        F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(fp, fp + tn).alias("false_positive_rate"),
        F.try_divide(fn, fn + tp).alias("false_negative_rate"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pattern_coverage(assessments: DataFrame, cfg=None) -> DataFrame:
    """Every registered rule with the number of assessments it fired in."""
    fired = (assessments.select(F.explode(F.array_distinct("violations.rule_name")).alias("rule_name"))
             .groupBy("rule_name").agg(F.count(F.lit(1)).alias("n")))
    listed = catalogue(assessments.sparkSession, cfg)
    return listed.join(fired, "rule_name", "left").select(
        "rule_name", "rule_version", "priority", "enabled", "config",
        F.coalesce("n", F.lit(0)).alias("fired"), (F.coalesce("n", F.lit(0)) > 0).alias("covered"))


def operational_metrics(rejected: DataFrame, repeats: DataFrame, assessments: DataFrame) -> DataFrame:
    """Operational counters of a run as (metric, tag, value) rows."""
    def single(frame, metric, value):
        return frame.agg(F.coalesce(value, F.lit(0)).cast("long").alias("value")).select(
            F.lit(metric).alias("metric"), F.lit("").alias("tag"), "value")

    def tagged(frame, metric, tag):
        return frame.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(metric).alias("metric"), "tag", "value")

    return (
        tagged(assessments, "assessments", "disposition")
        .unionByName(single(rejected, "dead_letters", F.count(F.lit(1))))
        .unionByName(single(repeats, "duplicate_deliveries", F.sum("repeats")))
        .unionByName(tagged(assessments.select(F.explode("rule_errors").alias("rule")), "rule_errors", "rule"))
    )
