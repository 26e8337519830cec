"""From violations to probability, score and verdict."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.config import ScoringConfig
from swipewatch.schemas import CLEARED, FLAGGED, PENDING_REVIEW


def _severity_ratio(severity: Column, cfg: ScoringConfig) -> Column:
    chosen = F.lit(None).cast("double")
    for name, ratio in cfg.severity_ratios.items():
        chosen = F.when(severity == name, F.lit(ratio)).otherwise(chosen)
    return chosen


def likelihood_ratio(rule_name: Column, severity: Column, cfg: ScoringConfig) -> Column:
    """Ratio listed for the rule at this severity, else the severity's own."""
    table = F.create_map(*[F.lit(x) for pair in cfg.likelihood_ratios.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.concat_ws(":", rule_name, severity)),
                      _severity_ratio(severity, cfg))


def fraud_probability(violations: Column, cfg: ScoringConfig) -> Column:
    prior = math.log(cfg.prior / (1.0 - cfg.prior))
    log_odds = F.aggregate(violations, F.lit(prior), lambda acc, v: acc + F.coalesce(
        F.ln(likelihood_ratio(v.rule_name, v.severity, cfg)), F.lit(0.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def probability_from_severities(severities: dict[str, str], cfg: ScoringConfig) -> Column:
    """The same probability from the names of one severity column per rule, without walking a list per row."""
    terms = [repr(math.log(cfg.prior / (1.0 - cfg.prior))) + "D"]
    for rule_name, column in severities.items():
        levels = " ".join(
            f"WHEN '{level}' THEN {math.log(cfg.likelihood_ratios.get(f'{rule_name}:{level}', default))!r}D"
            for level, default in cfg.severity_ratios.items())
        terms.append(f"CASE {column} {levels} ELSE 0.0D END")
    return F.expr(f"1.0D / (1.0D + exp(-({' + '.join(terms)})))")


def risk_score(probability: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(probability * 100.0 + 0.5))).cast("int")


def disposition(probability: Column, cfg: ScoringConfig) -> Column:
    return (F.when(probability >= cfg.flag_threshold, FLAGGED)
            .when(probability >= cfg.review_threshold, PENDING_REVIEW).otherwise(CLEARED))


def score(evaluated: DataFrame, cfg: ScoringConfig | None = None, probability: Column | None = None) -> DataFrame:
    """Adds ``fraud_probability``, ``risk_score`` and ``disposition`` to rows with ``violations``."""
    cfg = cfg or ScoringConfig()
    probability = fraud_probability(F.col("violations"), cfg) if probability is None else probability
    return evaluated.withColumn("fraud_probability", probability).withColumns({
        "risk_score": risk_score(F.col("fraud_probability")),
        "disposition": disposition(F.col("fraud_probability"), cfg),
    })
