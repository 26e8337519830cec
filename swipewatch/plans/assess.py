"""Transactions in, assessments out."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.config import DAY, HOUR, MINUTE, RuleConfig, ScoringConfig, SkewConfig
from swipewatch.operators.buckets import carried_rows
from swipewatch.operators.context import BUCKETED, EXACT, TRANSACTION_FIELDS, build_context
from swipewatch.operators.rules import RULES, active_rules, evaluate_rules, severity_column
from swipewatch.operators.scoring import probability_from_severities, score
from swipewatch.schemas import UNRESOLVED
from swipewatch.sources import tables

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ASSESSMENT_FIELDS = (
    "assessment_id", "transaction_id", "customer_id", "merchant_id", "amount", "currency", "category",
    "transaction_type", "timestamp", "risk_score", "fraud_probability", "disposition", "outcome",
    "assessed_at", "violations", "rule_errors",
)


def conclude(context: DataFrame, rule_cfg: RuleConfig | None = None, scoring_cfg: ScoringConfig | None = None,
             rules=RULES, assessed_at: Column | None = None) -> DataFrame:
    """Rules, score and verdict for rows that carry their context."""
    rule_cfg, scoring_cfg = rule_cfg or RuleConfig(), scoring_cfg or ScoringConfig()
    evaluated = evaluate_rules(context, rule_cfg, rules, keep_severities=True)
    severities = {rule.name: severity_column(rule) for rule in active_rules(rule_cfg, rules)}
    scored = score(evaluated, scoring_cfg, probability_from_severities(severities, scoring_cfg))
    own = {
        "assessment_id": F.col("transaction_id"), "outcome": F.lit(UNRESOLVED),
        "assessed_at": F.col("timestamp") if assessed_at is None else assessed_at,
    }
    return scored.select(*[own[name].alias(name) if name in own else name for name in ASSESSMENT_FIELDS])


def keys_of(txns: DataFrame) -> DataFrame:
    """Customer, id and time of the new transactions in a table of the shared folder: they are asked for several times,
    and what ``txns`` is made of is then evaluated once for all of these."""
    keys = txns.select("customer_id", "transaction_id", "timestamp")
    path = tables.join_path(tables.shared_folder(txns.sparkSession), f"new-keys-{uuid.uuid4().hex}")
    keys.write.parquet(path)
    return txns.sparkSession.read.schema(keys.schema).parquet(path)


def first_moment(keys: DataFrame) -> datetime | None:
    """One number, looked up before a plan is made so that it prunes files and partitions."""
    us = keys.agg(F.min(F.unix_micros("timestamp"))).first()[0]
    return None if us is None else EPOCH + timedelta(microseconds=us)


def relevant_history(keys: DataFrame, history: DataFrame, since: datetime | None) -> DataFrame:
    """The part of ``history`` from ``since`` on that the new transactions can see. Rows of ``history`` that are among them
    again are left out."""
    if since is None:
        return history.limit(0)
    seen = history.where(F.col("timestamp") >= F.lit(since))
    if "event_date" in history.columns:
        seen = seen.where(F.col("event_date") >= F.lit(since.date() - timedelta(days=1)))
    seen = seen.join(keys.select("customer_id").distinct(), "customer_id", "left_semi")
    return seen.join(keys.select("transaction_id"), "transaction_id", "left_anti")


def new_and_known(txns: DataFrame, known: DataFrame) -> DataFrame:
    return (txns.select(*TRANSACTION_FIELDS, F.lit(True).alias("is_new"))
            .unionByName(known.select(*TRANSACTION_FIELDS, F.lit(False).alias("is_new"))))


def assess(txns: DataFrame, merchants: DataFrame, rule_cfg: RuleConfig | None = None,
           scoring_cfg: ScoringConfig | None = None, mode: str = EXACT, skew: SkewConfig | None = None,
           rules=RULES, assessed_at: Column | None = None, history: DataFrame | None = None) -> DataFrame:
    """One assessment per transaction, outcome UNRESOLVED.

    ``history`` holds transactions assessed earlier: they are part of what each new one sees and are not assessed
    again. Only rows of the customers at hand are read, from the longest window before the first new transaction on;
    a history with ``event_date`` partitions is pruned to those days.

    ``assessed_at`` defaults to the transaction's own time, which keeps batch
    results repeatable.
    """
    if history is None:
        context = build_context(txns, merchants, rule_cfg, mode, skew)
    else:
        keys = keys_of(txns)
        first = first_moment(keys)
        known = relevant_history(keys, history, first and first - timedelta(days=(rule_cfg or RuleConfig()).baseline_days + 1))
        context = build_context(new_and_known(txns, known), merchants, rule_cfg, mode, skew, keep=("is_new",))
        context = context.where("is_new").drop("is_new")
    return conclude(context, rule_cfg, scoring_cfg, rules, assessed_at)


def assess_from_buckets(txns: DataFrame, merchants: DataFrame, history: DataFrame, hourly: DataFrame, daily: DataFrame,
                        rule_cfg: RuleConfig | None = None, scoring_cfg: ScoringConfig | None = None,
                        skew: SkewConfig | None = None, rules=RULES, assessed_at: Column | None = None) -> DataFrame:
    """What ``assess`` gives in bucketed mode with ``history``, without reading that history but for its latest part.

    ``hourly`` and ``daily`` are the stored tables of :mod:`swipewatch.operators.buckets` over all of ``history``. Sums up
    to the day of the first new transaction come from them: 24 hours and ``baseline_days`` days of small rows. Raw
    history is read from the start of that day on, or from one lookback before the first transaction if that is earlier.
    New transactions may lie on any number of days. Empty tables stand for an empty history.
    """
    cfg = rule_cfg or RuleConfig()
    keys = keys_of(txns)
    first = first_moment(keys)
    if first is None:
        return assess(txns, merchants, cfg, scoring_cfg, BUCKETED, skew, rules, assessed_at)
    us = (first - EPOCH) // timedelta(microseconds=1)
    day = us // DAY
    known = relevant_history(keys, history, EPOCH + timedelta(microseconds=min(day * DAY, us - cfg.lookback_minutes * MINUTE)))
    carried = carried_rows(hourly, daily, day, us // HOUR - 23, cfg.baseline_days)
    carried = carried.join(keys.select("customer_id").distinct(), "customer_id", "left_semi")
    context = build_context(new_and_known(txns, known), merchants, cfg, BUCKETED, skew, keep=("is_new",), carried=carried, since_us=day * DAY)
    return conclude(context.where("is_new").drop("is_new"), cfg, scoring_cfg, rules, assessed_at)
