from decimal import Decimal

import pytest

from swipewatch.config import RuleConfig, ScoringConfig, SkewConfig
from swipewatch.operators.rules import RULES, Rule, active_rules, register_rule, rule_named


@pytest.mark.parametrize("field", [
    "velocity_minutes", "geographic_minutes", "multi_channel_minutes", "device_minutes", "cloning_minutes",
    "cross_merchant_minutes", "hourly_minutes"])
def test_window_must_fit_the_lookback(field):
    RuleConfig(**{field: 60})
    with pytest.raises(ValueError, match=field):
        RuleConfig(**{field: 61})


def test_second_windows_must_fit_the_lookback():
    RuleConfig(duplicate_remote_seconds=3600)
    with pytest.raises(ValueError, match="duplicate_remote_seconds"):
        RuleConfig(duplicate_remote_seconds=3601)


def test_baseline_is_independent_of_the_lookback():
    assert RuleConfig(lookback_minutes=60, baseline_days=365).baseline_days == 365


def test_review_below_flag():
    with pytest.raises(ValueError):
        ScoringConfig(review_threshold=0.5, flag_threshold=0.5)


@pytest.mark.parametrize("broken", [dict(prior=0.0), dict(prior=1.0)])
def test_prior_is_a_probability(broken):
    with pytest.raises(ValueError):
        ScoringConfig(**broken)


def test_the_hot_list_stays_broadcastable():
    with pytest.raises(ValueError):
        SkewConfig(dense_rows=0)


def test_disabled_rules_leave_the_plan():
    names = [r.name for r in active_rules(RuleConfig(disabled=frozenset({"VELOCITY"})))]
    assert "VELOCITY" not in names and len(names) == 11


def test_unknown_disabled_rule():
    with pytest.raises(ValueError, match="NOPE"):
        active_rules(RuleConfig(disabled=frozenset({"NOPE"})))


def test_rules_run_by_priority():
    priorities = [r.priority for r in active_rules(RuleConfig())]
    assert priorities == sorted(priorities) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13]


def test_register_rule():
    extra = Rule("EXTRA", 20, lambda c: None, lambda c: None)
    assert rule_named("EXTRA", register_rule(extra)).priority == 20
    with pytest.raises(ValueError):
        register_rule(Rule("VELOCITY", 20, lambda c: None, lambda c: None))
    assert len(RULES) == 12


def test_limits_are_decimals():
    assert RuleConfig().hourly_limit == Decimal(10000)
