"""The twelve fraud rules as Column expressions over a transaction and its context.

A rule yields a severity, or NULL when it passes. Everything is null-safe and
overflow-safe, so one rule can never fail the rows of another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swipewatch.config import RuleConfig
from swipewatch.functions.columns import blank, is_physical, utc_hour

VERSION = "1.0"


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    severity: Callable[[RuleConfig], Column]
    describe: Callable[[RuleConfig], Column]
    settings: Callable[[RuleConfig], dict] = lambda cfg: {}
    version: str = VERSION
    # Optional: adds columns the rule needs, and the name of a column holding its error text.
    prepare: Callable[[DataFrame], DataFrame] | None = None
    error_column: str | None = None


def fires(condition: Column, severity: str) -> Column:
    return F.when(condition, F.lit(severity))


def money(amount: Column) -> Column:
    return amount.cast("decimal(33,2)").cast("string")


# --- conditions -------------------------------------------------------------------------------

def amount_limit(cfg: RuleConfig) -> Column:
    """Limit of the category, by its upper-case name, else the general one. A literal map keeps generated code short."""
    return F.coalesce(_by_category({k: F.lit(v).cast(LIMIT) for k, v in cfg.category_thresholds.items()}),
                      F.lit(cfg.amount_threshold).cast(LIMIT))


def amount_limit_text(cfg: RuleConfig) -> Column:
    return F.coalesce(_by_category({k: F.lit(f"{v:f}") for k, v in cfg.category_thresholds.items()}),
                      F.lit(f"{cfg.amount_threshold:f}"))


LIMIT = "decimal(19,4)"


def _by_category(values: dict[str, Column]) -> Column:
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), F.upper("category"))


def first_keyword(keywords) -> Column:
    """The first listed keyword contained in ``_category``, NULL if none is."""
    if not keywords:
        return F.lit(None).cast("string")
    cases = " ".join(f"WHEN contains(_category, {_quoted(word.upper())}) THEN {_quoted(word)}" for word in keywords)
    return F.expr(f"CASE {cases} END")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def off_hours(cfg: RuleConfig) -> Column:
    start, end = cfg.off_hours_start, cfg.off_hours_end
    return F.expr(f"_hour >= {start} {'OR' if start > end else 'AND'} _hour < {end}")


def velocity_severity(cfg: RuleConfig) -> Column:
    return F.when(F.col("velocity_count") >= cfg.velocity_max,
                  F.when(F.col("_high_keyword").isNotNull(), "CRITICAL").otherwise("HIGH"))


def hourly_total() -> Column:
    return F.col("hourly_spend") + F.col("amount")


def daily_total() -> Column:
    return F.col("daily_spend") + F.col("amount")


def over_hourly(cfg: RuleConfig) -> Column:
    return hourly_total() > F.lit(cfg.hourly_limit)


def duplicate_seconds(cfg: RuleConfig) -> Column:
    return F.when(F.col("transaction_type").eqNullSafe("CARD_NOT_PRESENT"), cfg.duplicate_remote_seconds).otherwise(
        cfg.duplicate_physical_seconds)


def other_channel_count() -> Column:
    return F.when(is_physical(F.col("transaction_type")), F.col("remote_count")).otherwise(F.col("physical_count"))


def z_score() -> Column:
    spread = F.when(F.col("baseline_stddev") != 0, F.col("baseline_stddev"))
    return (F.col("amount").cast("double") - F.col("baseline_mean")) / spread


# --- registry ---------------------------------------------------------------------------------
# Rule names, priorities (4 is vacant), severities and the description texts.

RULES: tuple[Rule, ...] = (
    Rule("AMOUNT_THRESHOLD", 1,
         lambda c: fires(F.col("amount") > amount_limit(c), "HIGH"),
         lambda c: F.format_string(
             "Transaction amount %s %s exceeds %s threshold %s", F.col("amount").cast("string"), "currency",
             F.when(blank(F.col("category")), "default").otherwise(F.col("category")), amount_limit_text(c)),
         lambda c: {"threshold": c.amount_threshold, "categoryThresholds": dict(c.category_thresholds)}),
    Rule("VELOCITY", 2,
         velocity_severity,
         lambda c: F.format_string(
             "Customer %s made %d transactions in %d minutes (max: %d)%s", "customer_id",
             F.col("velocity_count") + 1, F.lit(c.velocity_minutes), F.lit(c.velocity_max),
             F.when(F.col("_high_keyword").isNotNull(),
                    " — escalated to CRITICAL due to high-risk merchant category").otherwise("")),
         lambda c: {"windowMinutes": c.velocity_minutes, "maxTransactions": c.velocity_max}),
    Rule("DUPLICATE_TRANSACTION", 3,
         lambda c: fires(F.col("duplicate_seen"), "CRITICAL"),
         lambda c: F.format_string(
             "Duplicate transaction: same amount %s at merchant %s within %d seconds",
             F.col("amount").cast("string"), "merchant_id", duplicate_seconds(c)),
         lambda c: {"cardPresentWindowSeconds": c.duplicate_physical_seconds,
                    "cardNotPresentWindowSeconds": c.duplicate_remote_seconds}),
    Rule("GEOGRAPHIC_ANOMALY", 5,
         lambda c: fires(F.col("conflict_latitude").isNotNull(), "CRITICAL"),
         lambda c: F.format_string(
             "Physically impossible travel: [%.4f,%.4f] and [%.4f,%.4f] within %d minutes",
             "effective_latitude", "effective_longitude", "conflict_latitude", "conflict_longitude",
             F.lit(c.geographic_minutes)),
         lambda c: {"windowMinutes": c.geographic_minutes, "maxTravelSpeedKmh": c.geographic_max_kmh}),
    Rule("CARD_CLONING", 6,
         lambda c: fires(F.col("cloned_merchants") >= c.cloning_other_merchants, "MEDIUM"),
         lambda c: F.format_string(
             "Card cloning pattern: amount %s %s repeated at %d different merchants within %d minutes",
             F.col("amount").cast("string"), "currency", F.col("cloned_merchants") + 1, F.lit(c.cloning_minutes)),
         lambda c: {"windowMinutes": c.cloning_minutes, "minDifferentMerchants": c.cloning_other_merchants}),
    Rule("TIME_OF_DAY_ANOMALY", 7,
         lambda c: fires(off_hours(c), "MEDIUM"),
         lambda c: F.format_string(
             "Transaction at %02d:00 UTC falls within off-hours window (%02d:00–%02d:00 UTC)",
             "_hour", F.lit(c.off_hours_start), F.lit(c.off_hours_end)),
         lambda c: {"offHoursStartHour": c.off_hours_start, "offHoursEndHour": c.off_hours_end}),
    Rule("HIGH_RISK_MERCHANT_CATEGORY", 8,
         lambda c: F.when(F.col("_high_keyword").isNotNull(), "HIGH")
         .when(F.col("_medium_keyword").isNotNull(), "MEDIUM"),
         lambda c: F.when(F.col("_high_keyword").isNotNull(), F.format_string(
             "Transaction category '%s' matches high-risk keyword '%s'", "category", "_high_keyword"))
         .otherwise(F.format_string(
             "Transaction category '%s' matches elevated-risk keyword '%s'", "category", "_medium_keyword")),
         lambda c: {"highRiskKeywords": list(c.high_risk_keywords),
                    "mediumRiskKeywords": list(c.medium_risk_keywords)}),
    Rule("DEVICE_FINGERPRINT", 9,
         lambda c: fires(~blank(F.col("device_fingerprint")) & (F.col("known_devices") > 0)
                         & ~F.col("device_known"), "HIGH"),
         lambda c: F.format_string(
             "Transaction from unrecognised device fingerprint '%s' — %d known device(s) seen in last %d minutes",
             "device_fingerprint", "known_devices", F.lit(c.device_minutes)),
         lambda c: {"windowMinutes": c.device_minutes}),
    Rule("MULTI_CHANNEL_ANOMALY", 10,
         lambda c: fires(other_channel_count() > 0, "MEDIUM"),
         lambda c: F.format_string(
             "Rapid channel switch: %s transaction follows a %s transaction within %d minutes",
             F.when(is_physical(F.col("transaction_type")), "physical").otherwise("card-not-present"),
             F.when(is_physical(F.col("transaction_type")), "card-not-present").otherwise("physical"),
             F.lit(c.multi_channel_minutes)),
         lambda c: {"windowMinutes": c.multi_channel_minutes}),
    Rule("CROSS_MERCHANT_VELOCITY", 11,
         lambda c: fires(F.col("cross_merchant_count") + 1 >= c.cross_merchant_max, "MEDIUM"),
         lambda c: F.format_string(
             "%d transactions across merchants in %d minutes", F.col("cross_merchant_count") + 1,
             F.lit(c.cross_merchant_minutes)),
         lambda c: {"windowMinutes": c.cross_merchant_minutes, "maxTransactions": c.cross_merchant_max}),
    Rule("CUMULATIVE_SPENDING", 12,
         lambda c: fires(over_hourly(c) | (daily_total() > F.lit(c.daily_limit)), "HIGH"),
         lambda c: F.when(over_hourly(c), F.format_string(
             "Hourly spend %s %s exceeds limit %s %s", money(hourly_total()), "currency",
             F.lit(f"{c.hourly_limit:.2f}"), "currency")).otherwise(F.format_string(
                 "Daily spend %s %s exceeds limit %s %s", money(daily_total()), "currency",
                 F.lit(f"{c.daily_limit:.2f}"), "currency")),
         lambda c: {"hourlyLimit": c.hourly_limit, "dailyLimit": c.daily_limit,
                    "hourlyWindowMinutes": c.hourly_minutes}),
    Rule("CUSTOMER_AMOUNT_ANOMALY", 13,
         lambda c: fires((F.col("baseline_count") >= c.baseline_min_count) & (z_score() > c.baseline_sigmas), "MEDIUM"),
         lambda c: F.format_string(
             "Transaction amount %s %s is %.1f standard deviations above customer's %d-day average of %.2f (n=%d)",
             F.col("amount").cast("string"), "currency", z_score(), F.lit(c.baseline_days),
             "baseline_mean", "baseline_count"),
         lambda c: {"lookbackDays": c.baseline_days, "minHistoryCount": c.baseline_min_count,
                    "stddevMultiplier": c.baseline_sigmas}),
)


def register_rule(rule: Rule, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """A rule set with ``rule`` added."""
    if any(r.name == rule.name for r in rules):
        raise ValueError(f"rule {rule.name} is already registered")
    return rules + (rule,)


def rule_named(name: str, rules: tuple[Rule, ...] = RULES) -> Rule:
    for rule in rules:
        if rule.name == name:
            return rule
    raise ValueError(f"unknown rule {name!r}; known: {', '.join(sorted(r.name for r in rules))}")


def active_rules(cfg: RuleConfig, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    for name in cfg.disabled:
        rule_named(name, rules)
    return sorted((r for r in rules if r.name not in cfg.disabled), key=lambda r: r.priority)


NO_VIOLATIONS = "cast(array() as array<struct<rule_name:string,rule_version:string,description:string,severity:string>>)"


def with_severities(context: DataFrame, cfg: RuleConfig, active: list[Rule]) -> DataFrame:
    """One ``_sev_<priority>`` column per rule, shared by the violations and the score."""
    for rule in active:
        if rule.prepare:
            context = rule.prepare(context)
    context = context.withColumns({"_category": F.upper("category"), "_hour": utc_hour(F.col("us"))}).withColumns({
        "_high_keyword": first_keyword(cfg.high_risk_keywords),
        "_medium_keyword": first_keyword(cfg.medium_risk_keywords)})
    return context.withColumns({severity_column(rule): rule.severity(cfg) for rule in active})


def severity_column(rule: Rule) -> str:
    return f"_sev_{rule.priority}"


def evaluate_rules(context: DataFrame, cfg: RuleConfig | None = None,
                   rules: tuple[Rule, ...] = RULES, keep_severities: bool = False) -> DataFrame:
    """Adds ``violations`` (by priority) and ``rule_errors``. Every enabled rule is evaluated."""
    cfg = cfg or RuleConfig()
    active = active_rules(cfg, rules)
    rated = with_severities(context, cfg, active)
    none = F.expr(NO_VIOLATIONS)
    # Joining empty and one-element lists stays in generated code; filtering NULLs out of an array would not.
    found = F.concat(none, *[
        F.when(F.col(severity_column(rule)).isNotNull(), F.array(F.struct(
            F.lit(rule.name).alias("rule_name"), F.lit(rule.version).alias("rule_version"),
            rule.describe(cfg).alias("description"), F.col(severity_column(rule)).alias("severity"))))
        .otherwise(none) for rule in active])
    errors = F.expr("cast(array() as array<string>)")
    for rule in active:
        if rule.error_column:
            errors = F.concat(errors, F.when(F.col(rule.error_column).isNotNull(), F.array(F.lit(rule.name)))
                              .otherwise(F.expr("cast(array() as array<string>)")))
    severities = [severity_column(rule) for rule in active] if keep_severities else []
    return rated.select(*context.columns, *severities, found.alias("violations"), errors.alias("rule_errors"))


def rule_result(context: DataFrame, name: str, cfg: RuleConfig | None = None,
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The transactions one rule fires on, with its severity and description."""
    rule, cfg = rule_named(name, rules), cfg or RuleConfig()
    rated = with_severities(context, cfg, [rule]).where(F.col(severity_column(rule)).isNotNull())
    return rated.select(*context.columns, F.col(severity_column(rule)).alias("severity"),
                        rule.describe(cfg).alias("description"))


def python_rule(name: str, priority: int, columns: list[str],
                check: Callable[[pd.DataFrame], pd.DataFrame]) -> Rule:
    """A rule in vectorised Python: ``check`` gets a batch of ``columns`` and returns
    ``severity`` and ``description``, NULL where it passes.

    A batch on which it raises is retried row by row; rows that still raise
    count as a pass and are reported in ``rule_errors``.
    """
    field = f"_rule_{name.lower()}"

    def checked(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return check(frame)[["severity", "description"]].assign(error=None).reset_index(drop=True)
        except Exception as failure:
            if len(frame) <= 1:
                return pd.DataFrame([[None, None, repr(failure)]] * len(frame),
                                    columns=["severity", "description", "error"])
            return pd.concat([checked(frame.iloc[i:i + 1]) for i in range(len(frame))], ignore_index=True)

    @F.pandas_udf("severity string, description string, error string")
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return checked(frame)

    return Rule(
        name, priority,
        severity=lambda cfg: F.col(f"{field}.severity"),
        describe=lambda cfg: F.col(f"{field}.description"),
        prepare=lambda df: df.withColumn(field, run(F.struct(*columns))),
        error_column=f"{field}.error",
    )


def catalogue(spark: SparkSession, cfg: RuleConfig | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule: name, version, priority, enabled and its settings as text."""
    cfg = cfg or RuleConfig()
    rows = [(r.name, r.version, r.priority, r.name not in cfg.disabled,
             {key: str(value) for key, value in r.settings(cfg).items()}) for r in rules]
    return spark.createDataFrame(
        rows, "rule_name string, rule_version string, priority int, enabled boolean, config map<string,string>")
