"""Every query by name: (spark, folder of the test tables) -> DataFrame.

Transactions are derived from the whole ``events`` table. Reports, feeds and
joins read assessments scored once per session and stored, as a user would;
everything up to the score runs from the transactions each time.
"""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swipewatch.config import RuleConfig, ScoringConfig, SkewConfig
from swipewatch.functions.cursor import cursor_text
from swipewatch.operators import buckets, context, feeds, outcomes, reports, rules, scoring
from swipewatch.plans import assess as plans
from swipewatch.plans.assess import assess
from swipewatch import schemas
from swipewatch.schemas import CLEARED, FLAGGED, PENDING_REVIEW
from swipewatch.sources import demo, ingest, tables
from swipewatch.streaming import metrics
from swipewatch.streaming.commits import read_output

# Parameters of the parametrised queries.
CUSTOMER, MERCHANT, RULE = "CUST-000007", "MERCH-01", "MULTI_CHANNEL_ANOMALY"
TRANSACTION = "00000000-0000-0000-0000-000000005000"
FROM, TO = datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 22, 12, tzinfo=timezone.utc)
SINCE = datetime(2024, 1, 15, tzinfo=timezone.utc)
CURSOR_AT, CURSOR_ID = datetime(2024, 1, 15, 12, tzinfo=timezone.utc), "00000000-0000-0000-0000-000000005000"
RETENTION_AS_OF = date(2024, 4, 14)
DAILY_CASE = RuleConfig(hourly_limit=Decimal(10 ** 9), daily_limit=Decimal(8000))
SHORT_BASELINE = RuleConfig(baseline_days=10)
SMALL_SKEW = SkewConfig(hot_rows=60, block_rows=100)

_stored: dict[tuple, str] = {}


def folder_label(sf_dir: str) -> str:
    return re.sub(r"\W+", "_", sf_dir).strip("_")


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build()`` written once per session to the shared folder, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        label = folder_label(sf_dir)
        path = tables.join_path(tables.shared_folder(spark), key[0], label, name)
        tables.write_assessments(build(), path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def transactions(spark, sf_dir) -> DataFrame:
    tables.prepare_session(spark)
    return demo.transactions(spark, sf_dir).drop("event_id", "k")


def raw(spark, sf_dir) -> DataFrame:
    tables.prepare_session(spark)
    return demo.raw_events(spark, sf_dir)


def assessments(spark, sf_dir) -> DataFrame:
    txns = transactions(spark, sf_dir)
    return stored(spark, sf_dir, "assessments", lambda: assess(txns, demo.merchants(spark)))


def resolved_assessments(spark, sf_dir) -> DataFrame:
    return outcomes.resolve_outcomes(assessments(spark, sf_dir), demo.outcome_requests(spark, sf_dir))[0]


def full_context(spark, sf_dir, cfg=None, mode=context.EXACT, skew=None) -> DataFrame:
    return context.build_context(transactions(spark, sf_dir), demo.merchants(spark), cfg, mode, skew)


# --- plain output columns ---------------------------------------------------------------------------

def us(name: str) -> Column:
    return F.unix_micros(name).alias(f"{name}_us")


def number(column, name: str | None = None, digits: int | None = None) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    value = column.cast("double")
    value = value if digits is None else F.round(value, digits)
    return value.alias(name) if name else value


def rule_text() -> Column:
    return F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v.rule_name, v.severity)), ",").alias("rules")


def verdicts(assessed: DataFrame) -> DataFrame:
    return assessed.select(
        "transaction_id", "customer_id", "merchant_id", "risk_score", number("fraud_probability", "fraud_probability", 9),
        "disposition", "outcome", us("assessed_at"), rule_text())


def page_rows(page: DataFrame, time: str = "assessed_at") -> DataFrame:
    return page.select("transaction_id", "customer_id", "merchant_id", us(time), "position", "has_more", "next_cursor")


# --- A: sources, sinks, ingestion -------------------------------------------------------------------

def _transaction_columns() -> list:
    return ["transaction_id", "customer_id", "merchant_id", number("amount", "amount"), "currency", "category",
            "latitude", "longitude", "device_fingerprint", us("timestamp"), "transaction_type"]


def scan_transactions(spark, d):
    return transactions(spark, d).select(*_transaction_columns())


def normalise_events(spark, d):
    return ingest.normalise_events(raw(spark, d)).select(*_transaction_columns(), "delivery", us("ingest_ts"))


def spoilt(spark, sf_dir) -> DataFrame:
    tables.prepare_session(spark)
    return demo.spoilt_events(spark, sf_dir)


def _checked(checked: DataFrame) -> DataFrame:
    return checked.select("event_id", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors.field", ",").alias("fields"))


def validate_stream(spark, d):
    return _checked(ingest.with_stream_errors(ingest.normalise_events(spoilt(spark, d))))


def validate_submit(spark, d):
    return _checked(ingest.with_submit_errors(spoilt(spark, d)))


def _valid_and_rejected(spark, d):
    return ingest.validate(ingest.normalise_events(raw(spark, d)))


def quarantine(spark, d):
    return ingest.quarantine(_valid_and_rejected(spark, d)[1]).select(
        "transaction_id", "delivery", "sent_amount", "currency", "reason", "attempts", "status")


def dedupe_transactions(spark, d):
    new, _ = ingest.dedupe(_valid_and_rejected(spark, d)[0])
    return new.select("transaction_id", "customer_id", number("amount", "amount"), "delivery", us("ingest_ts"))


def duplicate_deliveries(spark, d):
    return ingest.dedupe(_valid_and_rejected(spark, d)[0])[1]


def resubmitted_assessments(spark, d):
    _, repeats = ingest.dedupe(_valid_and_rejected(spark, d)[0])
    return verdicts(ingest.stored_assessments(repeats, assessments(spark, d)))


def assign_missing_ids(spark, d):
    requests = transactions(spark, d).withColumns({
        "transaction_id": F.when(~F.coalesce("device_fingerprint", F.lit("")).startswith("dev-new"), F.col("transaction_id")),
        "sent_us": F.unix_micros("timestamp")})
    return ingest.assign_missing_ids(requests, ["customer_id", "merchant_id", "amount", "currency", "sent_us"]).select(
        "transaction_id", "customer_id", "merchant_id", "sent_us")


def merchant_dim(spark, d):
    seen = transactions(spark, d).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(demo.merchants(spark), "merchant_id", "left").select(
        "merchant_id", "n", "latitude", "longitude", "city", "country", F.col("city").isNotNull().alias("known"))


def write_assessments(spark, d):
    return tables.explode_violations(assessments(spark, d)).select(
        "assessment_id", F.col("position").cast("long").alias("position"), "rule_name", "rule_version", "severity")


def _route(verdict, time):
    def run(spark, d):
        routed = tables.route(assessments(spark, d))[verdict]
        plain = [c for c in routed.columns if c not in (time, "amount")]
        amount = [number("amount", "amount")] if "amount" in routed.columns else []
        return routed.select(*plain, *amount, us(time))
    return run


def write_daily_partitions(spark, d):
    key = (spark.sparkContext.applicationId, d, "daily")
    txns = transactions(spark, d)
    if key not in _stored:
        path = tables.join_path(tables.shared_folder(spark), key[0], folder_label(d), "daily")
        tables.write_daily_partitions(txns, path)
        _stored[key] = path
    return (spark.read.parquet(_stored[key])
            .groupBy(F.col("event_date").cast("string").alias("event_date"))
            .agg(F.count(F.lit(1)).alias("n"), number(F.sum("amount"), "total")))


def split_retention(spark, d):
    active, archived = tables.split_retention(transactions(spark, d), RETENTION_AS_OF)
    return (active.select(F.lit("active").alias("part"), F.to_date("timestamp").cast("string").alias("event_date"))
            .unionByName(archived.select(F.lit("archived").alias("part"),
                                         F.to_date("timestamp").cast("string").alias("event_date")))
            .groupBy("part", "event_date").agg(F.count(F.lit(1)).alias("n")))


def status_counts(spark, d):
    events = ingest.normalise_events(raw(spark, d))
    valid, rejected = ingest.validate(events)
    listed = events.where(F.col("transaction_id").isNotNull()).select("transaction_id").distinct()
    accepted = assessments(spark, d).join(valid.select("transaction_id").distinct(), "transaction_id", "left_semi")
    return (ingest.transaction_status(listed, accepted, rejected).groupBy("status").agg(F.count(F.lit(1)).alias("n")))


# --- B, C: projections, filters, joins --------------------------------------------------------------

def _slim(frame):
    return frame.select("transaction_id", "customer_id", "merchant_id", "risk_score", "disposition", us("assessed_at"))


def filter_optional_and(spark, d):
    return _slim(feeds.where_all(
        assessments(spark, d), feeds.equal_to(disposition=FLAGGED, merchant_id=MERCHANT, customer_id=None)
        + feeds.score_band(60, None) + feeds.time_range("assessed_at", FROM, None)))


def filter_time_range(spark, d):
    return _slim(feeds.where_all(assessments(spark, d), feeds.time_range("assessed_at", FROM, TO)))


def filter_score_band(spark, d):
    return _slim(feeds.where_all(assessments(spark, d), feeds.score_band(10, 60)))


def lookup_transaction(spark, d):
    return feeds.lookup(transactions(spark, d), TRANSACTION).select(*_transaction_columns())


def lookup_assessment(spark, d):
    return verdicts(feeds.lookup(assessments(spark, d), TRANSACTION))


def project_transaction_summary(spark, d):
    joined = feeds.history_with_assessment(transactions(spark, d), assessments(spark, d))
    return joined.select(*_transaction_columns(), F.col("assessment.risk_score").alias("risk_score"),
                         F.col("assessment.disposition").alias("disposition"),
                         F.col("assessment.outcome").alias("outcome"))


def project_assessment(spark, d):
    return verdicts(assessments(spark, d))


def filter_resolved(spark, d):
    return feeds.resolved(resolved_assessments(spark, d)).select("transaction_id", "disposition", "outcome")


def history_with_assessment(spark, d):
    # Every transaction against all assessments but those of events that were never accepted, so both sides of the
    # outer join occur.
    rejected = _valid_and_rejected(spark, d)[1].select("transaction_id")
    joined = feeds.history_with_assessment(
        transactions(spark, d), assessments(spark, d).join(rejected, "transaction_id", "left_anti"))
    return joined.select("transaction_id", "customer_id", us("timestamp"),
                         F.col("assessment.risk_score").alias("risk_score"),
                         F.coalesce(F.size("assessment.violations"), F.lit(0)).cast("long").alias("n_violations"))


def assessment_details(spark, d):
    return feeds.assessment_details(transactions(spark, d), assessments(spark, d)).select(
        "assessment_id", "transaction_id", "category", "latitude", "longitude", "device_fingerprint", "risk_score",
        F.size("violations").cast("long").alias("n_violations"))


def semi_join_rule(spark, d):
    assessed = assessments(spark, d)
    return _slim(feeds.semi_join_rule(assessed, tables.explode_violations(assessed), RULE))


def nested_rule_filter(spark, d):
    return _slim(feeds.where_all(assessments(spark, d), feeds.broke_rule(RULE)))


def merchant_fallback(spark, d):
    return context.merchant_fallback(transactions(spark, d), demo.merchants(spark)).select(
        "transaction_id", "merchant_latitude", "merchant_longitude")


def violations_join(spark, d):
    return (tables.explode_violations(assessments(spark, d)).groupBy("rule_name", "severity")
            .agg(F.count(F.lit(1)).alias("n")))


# --- D: context --------------------------------------------------------------------------------------

def recent_context(spark, d):
    return full_context(spark, d).select("transaction_id", "recent_count", "velocity_count", "cross_merchant_count",
                                         "physical_count", "remote_count", number("hourly_spend", "hourly_spend"))


def recent_transactions(spark, d):
    """The context list of one transaction, newest first, as a table of rows."""
    txns = context.with_event_time(transactions(spark, d))
    return context.recent_transactions(txns, TRANSACTION, RuleConfig()).select(
        "transaction_id", "merchant_id", number("amount", "amount"), "currency", "us")


def _spend(mode):
    return lambda spark, d: full_context(spark, d, mode=mode).select(
        "transaction_id", number("daily_spend", "daily_spend"))


def _baseline(mode, cfg=None):
    return lambda spark, d: full_context(spark, d, cfg, mode).select(
        "transaction_id", "baseline_count", number("baseline_mean", "baseline_mean", 6),
        number("baseline_stddev", "baseline_stddev", 6))


def hourly_buckets(spark, d):
    return buckets.hourly_buckets(transactions(spark, d)).withColumn("spend", number("spend"))


def daily_buckets(spark, d):
    return buckets.daily_buckets(transactions(spark, d)).withColumn("total", number("total"))


def windowed_spend(spark, d):
    return buckets.windowed_spend(transactions(spark, d)).select(
        "customer_id", "currency", us("starts_at"), number("spend", "spend"), "n")


def effective_location(spark, d):
    return context.effective_location(transactions(spark, d), demo.merchants(spark)).select(
        "transaction_id", "effective_latitude", "effective_longitude")


def _bundle(mode, skew=None):
    def run(spark, d):
        c = full_context(spark, d, mode=mode, skew=skew)
        return c.select(
            "transaction_id", "recent_count", "velocity_count", "cross_merchant_count", "physical_count", "remote_count",
            "duplicate_seen", "cloned_merchants", "known_devices", "device_known",
            number("hourly_spend", "hourly_spend"), number("daily_spend", "daily_spend"), "baseline_count",
            number("baseline_mean", "baseline_mean", 6), number("baseline_stddev", "baseline_stddev", 6),
            "conflict_latitude", "conflict_longitude", "effective_latitude", "effective_longitude")
    return run


# --- E, F: rules and scores ---------------------------------------------------------------------------

def _rule(name, cfg=None):
    return lambda spark, d: rules.rule_result(full_context(spark, d, cfg), name, cfg).select("transaction_id", "severity")


def evaluate_rules(spark, d):
    return rules.evaluate_rules(full_context(spark, d)).select("transaction_id", rule_text())


def list_rules(spark, d):
    return reports.pattern_coverage(assessments(spark, d)).select("rule_name", "rule_version", "priority", "enabled",
                                                                  F.size("config").cast("long").alias("n_settings"), "fired")


def likelihood_ratio(spark, d):
    v = tables.explode_violations(assessments(spark, d))
    return (v.withColumn("ratio", scoring.likelihood_ratio(F.col("rule_name"), F.col("severity"), ScoringConfig()))
            .groupBy("rule_name", "severity", "ratio").agg(F.count(F.lit(1)).alias("n")))


def severity_fallback(spark, d):
    """Scores with an empty ratio table, so every violation counts by its severity alone."""
    cfg = replace(ScoringConfig(), likelihood_ratios={})
    plain = assessments(spark, d).select("transaction_id", "violations")
    return scoring.score(plain, cfg).select("transaction_id", "risk_score", "disposition")


def fraud_probability(spark, d):
    plain = assessments(spark, d)
    return plain.select("transaction_id", number(
        scoring.fraud_probability(F.col("violations"), ScoringConfig()), "fraud_probability", 9))


def risk_score(spark, d):
    return assessments(spark, d).groupBy("risk_score").agg(F.count(F.lit(1)).alias("n"))


def disposition(spark, d):
    return assessments(spark, d).select("transaction_id", "disposition")


def _assess(mode=context.EXACT, skew=None, cfg=None):
    return lambda spark, d: verdicts(assess(
        transactions(spark, d), demo.merchants(spark), rule_cfg=cfg, mode=mode, skew=skew))


# --- G: reports -----------------------------------------------------------------------------------------

def _totals(column, *, name):
    return lambda spark, d: reports.assessed_totals(assessments(spark, d), FROM, TO).select(F.col(column).alias(name))


def rule_breakdown(spark, d):
    return reports.rule_breakdown(assessments(spark, d), FROM, TO)


def fraud_summary(spark, d):
    s = reports.fraud_summary(assessments(spark, d), FROM, TO)
    return s.select("total_assessed", "total_flagged", "total_not_flagged", "fraud_rate", F.array_join(F.transform(
        "rule_breakdown", lambda r: F.concat_ws("=", r.rule_name, r.flagged_count.cast("string"))), ",").alias("breakdown"))


def _summary(by):
    def run(spark, d):
        s = reports.risk_summary(transactions(spark, d), assessments(spark, d), by, SINCE)
        extra = ["unique_customers"] if by == "merchant_id" else []
        return s.select(by, "total_transactions", "flagged_count", "not_flagged_count", "fraud_rate",
                        "highest_risk_score", *extra, F.array_join("most_triggered_rules", ",").alias("top_rules"),
                        us("first_transaction_at"), us("last_transaction_at"))
    return run


def _txn_count(by):
    return lambda spark, d: reports.txn_count(transactions(spark, d), by, SINCE)


def _flagged_count(by):
    return lambda spark, d: reports.flagged_count(assessments(spark, d), by, SINCE)


def _max_score(by):
    return lambda spark, d: reports.max_score(assessments(spark, d), by, SINCE)


def _top_rules(by):
    return lambda spark, d: reports.top_rules(assessments(spark, d), by, SINCE).withColumn("rank", F.col("rank").cast("long"))


def _first_last(by):
    return lambda spark, d: reports.first_last(transactions(spark, d), by).select(
        by, us("first_transaction_at"), us("last_transaction_at"))


def merchant_unique_customers(spark, d):
    return reports.unique_customers(transactions(spark, d))


def disposition_counts(spark, d):
    return reports.disposition_counts(assessments(spark, d))


def operational_metrics(spark, d):
    valid, rejected = _valid_and_rejected(spark, d)
    new, repeats = ingest.dedupe(valid)
    accepted = assessments(spark, d).join(new.select("transaction_id"), "transaction_id", "left_semi")
    return reports.operational_metrics(rejected, repeats, accepted)


def detection_metrics(spark, d):
    m = reports.detection_metrics(resolved_assessments(spark, d))
    return m.select("tp", "fn", "fp", "tn", *[number(c, c, 9) for c in (
        "sensitivity", "specificity", "precision", "false_positive_rate", "false_negative_rate", "f1")])


def pattern_coverage(spark, d):
    return reports.pattern_coverage(assessments(spark, d)).select("rule_name", "fired", "covered")


# --- H: feeds -------------------------------------------------------------------------------------------

def feed_customer_history(spark, d):
    page = feeds.customer_history(transactions(spark, d), assessments(spark, d), CUSTOMER, from_=FROM, to=TO,
                                  page_size=10, sort="asc")
    return page.select("transaction_id", "merchant_id", us("timestamp"),
                       F.col("assessment.risk_score").alias("risk_score"),
                       F.col("assessment.disposition").alias("disposition"), "position", "has_more", "next_cursor")


def feed_flagged(spark, d):
    return page_rows(feeds.feed(assessments(spark, d), FLAGGED, rule=RULE, min_score=57, max_score=99,
                                from_=FROM, to=TO, page_size=50))


def feed_pending_review(spark, d):
    return page_rows(feeds.feed(assessments(spark, d), PENDING_REVIEW, min_score=11, page_size=25, sort="asc"))


def feed_passed(spark, d):
    return page_rows(feeds.feed(assessments(spark, d), CLEARED, min_score=2, from_=FROM))


def feed_merchant_flagged(spark, d):
    return page_rows(feeds.feed(assessments(spark, d), FLAGGED, merchant_id=MERCHANT, page_size=1000))


def keyset_page(spark, d):
    return page_rows(feeds.keyset_page(assessments(spark, d), "assessed_at", "assessment_id",
                                       cursor_text(CURSOR_AT, CURSOR_ID), 100))


def feed_pages(spark, d):
    flagged = assessments(spark, d).where(F.col("disposition") == FLAGGED)
    return feeds.feed_pages(flagged, "assessed_at", "assessment_id").select("transaction_id", "row_number", "page")


def cursor_codec(spark, d):
    return assessments(spark, d).select("transaction_id", feeds.encode_cursor(
        F.unix_micros("assessed_at"), F.col("assessment_id")).alias("cursor"))


def top_k_rules(spark, d):
    return reports.top_k_rules(assessments(spark, d))


# --- I: outcomes ----------------------------------------------------------------------------------------

def resolve_outcomes(spark, d):
    return resolved_assessments(spark, d).select("transaction_id", "disposition", "outcome")


def outcome_status(spark, d):
    statuses = outcomes.resolve_outcomes(assessments(spark, d), demo.outcome_requests(spark, d))[1]
    return statuses.select("event_id", "transaction_id", "requested", us("recorded_at"), "status", "standing_outcome")


def outcome_log(spark, d):
    """The same requests as two batches of a log: first calls, then second ones."""
    key = (spark.sparkContext.applicationId, d, "outcomes")
    requests, assessed = demo.outcome_requests(spark, d), assessments(spark, d)
    if key not in _stored:
        folder = tables.join_path(tables.shared_folder(spark), key[0], folder_label(d), "outcomes")
        for batch in (1, 2):
            calls = requests.where(F.col("event_id").endswith(f"-{batch}"))
            outcomes.record(calls, assessed, tables.join_path(folder, "log"), batch).write.parquet(tables.join_path(folder, f"status-{batch}"))
        _stored[key] = folder
    statuses = [spark.read.parquet(tables.join_path(_stored[key], f"status-{batch}")) for batch in (1, 2)]
    return statuses[0].unionByName(statuses[1]).select(
        "event_id", "transaction_id", "requested", us("recorded_at"), "status", "standing_outcome")


def outcome_counts(spark, d):
    return reports.outcome_counts(resolved_assessments(spark, d))


# --- J: stream ------------------------------------------------------------------------------------------

def assess_incremental(spark, d):
    """The later half of the transactions, the earlier half being stored history."""
    txns = transactions(spark, d)
    new, history = txns.where(F.col("timestamp") >= F.lit(SINCE)), txns.where(F.col("timestamp") < F.lit(SINCE))
    return verdicts(assess(new, demo.merchants(spark), history=history))


def assess_from_buckets(spark, d):
    """Everything from the middle of a day on, with older days known from bucket tables alone. The tables are kept up to
    date by two deliveries that share customers, hours and days."""
    txns = transactions(spark, d)
    new, history = txns.where(F.col("timestamp") >= F.lit(CURSOR_AT)), txns.where(F.col("timestamp") < F.lit(CURSOR_AT))
    key = (spark.sparkContext.applicationId, d, "buckets")
    if key not in _stored:
        folder = tables.join_path(tables.shared_folder(spark), key[0], folder_label(d), "buckets")
        late = F.col("transaction_type").eqNullSafe("ATM")
        buckets.add_deltas(history.where(~late), folder, "first")
        buckets.add_deltas(history.where(late), folder, "second")
        _stored[key] = folder
    return verdicts(plans.assess_from_buckets(new, demo.merchants(spark), history, *buckets.read_deltas(spark, _stored[key])))


def stream_redelivery(spark, d):
    """The stream fed every transaction, and then, days later, all of the first half once more, under other customers."""
    from swipewatch.streaming.run import replay
    key = (spark.sparkContext.applicationId, d, "redelivery")
    txns = transactions(spark, d)
    if key not in _stored:
        folder = tables.join_path(tables.shared_folder(spark), key[0], folder_label(d), "redelivery")
        _stored[key] = replay(spark, txns, demo.merchants(spark), folder, slice_days=15,
                              again=txns.where(F.col("timestamp") < F.lit(SINCE))
                              .withColumn("customer_id", F.concat("customer_id", F.lit("-other"))))
    return verdicts(read_output(spark, _stored[key], "assessments"))


def stream_assess(spark, d):
    from swipewatch.streaming.run import replay
    key = (spark.sparkContext.applicationId, d, "stream")
    txns = transactions(spark, d)
    if key not in _stored:
        folder = tables.join_path(tables.shared_folder(spark), key[0], folder_label(d), "stream")
        _stored[key] = replay(spark, txns, demo.merchants(spark), folder, slice_days=15)
    return verdicts(read_output(spark, _stored[key], "assessments"))


def stream_metrics(spark, d):
    """What a stream counted while it took all events as sent, broken ones among them, and then the second deliveries."""
    from swipewatch.streaming import run
    key = (spark.sparkContext.applicationId, d, "metrics")
    if key not in _stored:
        folder = tables.join_path(tables.shared_folder(spark), key[0], folder_label(d), "metrics")
        events, counters, inbox = raw(spark, d), metrics.StreamCounters(), tables.join_path(folder, "inbox")
        spark.streams.addListener(counters)
        try:
            for delivery in (1, 2):
                events.where(F.col("delivery") == delivery).select(*schemas.RAW_EVENT.fieldNames()).write.mode("append").parquet(inbox)
                run.start_scoring(tables.stream_transactions(spark, inbox), lambda: demo.merchants(spark), folder,
                                  assessed_at=F.col("timestamp")).awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        finally:
            spark.streams.removeListener(counters)
        counters.rows(spark).write.parquet(tables.join_path(folder, "counters"))
        _stored[key] = folder
    found = metrics.merged(read_output(spark, _stored[key], "metrics").where("metric <> 'latency_class'"))
    return found.unionByName(spark.read.parquet(tables.join_path(_stored[key], "counters")))


RULE_KEYS = {
    "rule_amount_threshold": "AMOUNT_THRESHOLD", "rule_velocity": "VELOCITY",
    "rule_duplicate": "DUPLICATE_TRANSACTION", "rule_geographic": "GEOGRAPHIC_ANOMALY",
    "rule_card_cloning": "CARD_CLONING", "rule_time_of_day": "TIME_OF_DAY_ANOMALY",
    "rule_high_risk_category": "HIGH_RISK_MERCHANT_CATEGORY", "rule_device_fingerprint": "DEVICE_FINGERPRINT",
    "rule_multi_channel": "MULTI_CHANNEL_ANOMALY", "rule_cross_merchant_velocity": "CROSS_MERCHANT_VELOCITY",
    "rule_cumulative_spending": "CUMULATIVE_SPENDING", "rule_customer_amount_anomaly": "CUSTOMER_AMOUNT_ANOMALY",
}

QUERIES = {
    "assess": _assess(),
    "assess_bucketed": _assess(context.BUCKETED),
    "assess_incremental": assess_incremental,
    "assess_from_buckets": assess_from_buckets,
    "assess_hot_customers": _assess(skew=SMALL_SKEW),
    "assess_bucketed_hot_customers": _assess(context.BUCKETED, SMALL_SKEW),
    "scan_transactions": scan_transactions,
    "normalise_events": normalise_events,
    "validate_stream": validate_stream,
    "validate_submit": validate_submit,
    "quarantine": quarantine,
    "dedupe_transactions": dedupe_transactions,
    "duplicate_deliveries": duplicate_deliveries,
    "resubmitted_assessments": resubmitted_assessments,
    "assign_missing_ids": assign_missing_ids,
    "merchant_dim": merchant_dim,
    "write_assessments": write_assessments,
    "route_flagged": _route(FLAGGED, "assessed_at"),
    "route_pending_review": _route(PENDING_REVIEW, "assessed_at"),
    "route_cleared": _route(CLEARED, "timestamp"),
    "write_daily_partitions": write_daily_partitions,
    "split_retention": split_retention,
    "status_counts": status_counts,
    "filter_optional_and": filter_optional_and,
    "filter_time_range": filter_time_range,
    "filter_score_band": filter_score_band,
    "lookup_transaction": lookup_transaction,
    "lookup_assessment": lookup_assessment,
    "project_transaction_summary": project_transaction_summary,
    "project_assessment": project_assessment,
    "filter_resolved": filter_resolved,
    "history_with_assessment": history_with_assessment,
    "assessment_details": assessment_details,
    "semi_join_rule": semi_join_rule,
    "nested_rule_filter": nested_rule_filter,
    "merchant_fallback": merchant_fallback,
    "violations_join": violations_join,
    "recent_context": recent_context,
    "recent_transactions": recent_transactions,
    "daily_spend_exact": _spend(context.EXACT),
    "daily_spend_bucketed": _spend(context.BUCKETED),
    "baseline_exact": _baseline(context.EXACT),
    "baseline_bucketed": _baseline(context.BUCKETED),
    "baseline_exact_10_days": _baseline(context.EXACT, SHORT_BASELINE),
    "baseline_bucketed_10_days": _baseline(context.BUCKETED, SHORT_BASELINE),
    "hourly_buckets": hourly_buckets,
    "daily_buckets": daily_buckets,
    "windowed_spend": windowed_spend,
    "effective_location": effective_location,
    "context_bundle": _bundle(context.EXACT),
    "context_bundle_bucketed": _bundle(context.BUCKETED),
    "context_bundle_hot_customers": _bundle(context.EXACT, SMALL_SKEW),
    **{key: _rule(name) for key, name in RULE_KEYS.items()},
    "rule_cumulative_spending_daily": _rule("CUMULATIVE_SPENDING", DAILY_CASE),
    "evaluate_rules": evaluate_rules,
    "list_rules": list_rules,
    "likelihood_ratio": likelihood_ratio,
    "severity_fallback": severity_fallback,
    "fraud_probability": fraud_probability,
    "risk_score": risk_score,
    "disposition": disposition,
    "count_assessed": _totals("total_assessed", name="n"),
    "count_flagged": _totals("total_flagged", name="n"),
    "rule_breakdown": rule_breakdown,
    "fraud_summary": fraud_summary,
    "customer_risk_summary": _summary("customer_id"),
    "customer_txn_count": _txn_count("customer_id"),
    "customer_flagged_count": _flagged_count("customer_id"),
    "customer_max_score": _max_score("customer_id"),
    "customer_top_rules": _top_rules("customer_id"),
    "customer_first_last": _first_last("customer_id"),
    "merchant_risk_summary": _summary("merchant_id"),
    "merchant_txn_count": _txn_count("merchant_id"),
    "merchant_flagged_count": _flagged_count("merchant_id"),
    "merchant_max_score": _max_score("merchant_id"),
    "merchant_top_rules": _top_rules("merchant_id"),
    "merchant_first_last": _first_last("merchant_id"),
    "merchant_unique_customers": merchant_unique_customers,
    "disposition_counts": disposition_counts,
    "operational_metrics": operational_metrics,
    "detection_metrics": detection_metrics,
    "pattern_coverage": pattern_coverage,
    "feed_customer_history": feed_customer_history,
    "feed_flagged": feed_flagged,
    "feed_pending_review": feed_pending_review,
    "feed_passed": feed_passed,
    "feed_merchant_flagged": feed_merchant_flagged,
    "keyset_page": keyset_page,
    "feed_pages": feed_pages,
    "cursor_codec": cursor_codec,
    "top_k_rules": top_k_rules,
    "resolve_outcomes": resolve_outcomes,
    "outcome_status": outcome_status,
    "outcome_log": outcome_log,
    "outcome_counts": outcome_counts,
    "stream_assess": stream_assess,
    "stream_redelivery": stream_redelivery,
    "stream_metrics": stream_metrics,
}
