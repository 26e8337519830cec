import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import BUSINESS, OFF_HOURS, frame, merchants, txn
from swipewatch.config import LIKELIHOOD_RATIOS, RuleConfig, ScoringConfig
from swipewatch.operators.rules import evaluate_rules, python_rule, register_rule
from swipewatch.operators.scoring import likelihood_ratio, score
from swipewatch.operators.context import build_context
from swipewatch.plans.assess import assess, conclude

SCHEMA = "id string, violations array<struct<rule_name:string,rule_version:string,description:string,severity:string>>"


def scored(spark, cases, cfg=None):
    rows = [(name, [(rule, "1.0", None, severity) for rule, severity in found]) for name, found in cases.items()]
    return {r["id"]: r for r in score(spark.createDataFrame(rows, SCHEMA), cfg).collect()}


def test_single_and_combined_ratios(spark):
    cases = {key: [tuple(key.split(":"))] for key in LIKELIHOOD_RATIOS}
    cases["none"] = []
    cases["3*5"] = [("TIME_OF_DAY_ANOMALY", "MEDIUM"), ("MULTI_CHANNEL_ANOMALY", "MEDIUM")]
    cases["2*5"] = [("AMOUNT_THRESHOLD", "HIGH"), ("MULTI_CHANNEL_ANOMALY", "MEDIUM")]
    cases["5*5*5"] = [("MULTI_CHANNEL_ANOMALY", "MEDIUM"), ("CUSTOMER_AMOUNT_ANOMALY", "MEDIUM"),
                      ("HIGH_RISK_MERCHANT_CATEGORY", "MEDIUM")]
    cases["everything"] = [tuple(key.split(":")) for key in LIKELIHOOD_RATIOS]
    got = scored(spark, cases)
    for name, found in cases.items():
        product = math.prod(LIKELIHOOD_RATIOS[":".join(v)] for v in found)
        p = product / (99 + product)
        assert got[name]["fraud_probability"] == pytest.approx(p, rel=1e-12)
        assert got[name]["risk_score"] == min(100, math.floor(100 * p + 0.5))
        assert got[name]["disposition"] == ("FLAGGED" if p >= 0.5 else "PENDING_REVIEW" if p >= 0.1 else "CLEARED")
    assert (got["none"]["risk_score"], got["3*5"]["risk_score"], got["2*5"]["risk_score"]) == (1, 13, 9)
    assert got["5*5*5"]["disposition"] == "FLAGGED" and got["everything"]["risk_score"] == 100


def test_unlisted_rule_counts_by_severity(spark):
    got = scored(spark, {s: [("SOMETHING_NEW", s)] for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")})
    for severity, ratio in {"LOW": 1.3, "MEDIUM": 3.0, "HIGH": 9.0, "CRITICAL": 120.0}.items():
        assert got[severity]["fraud_probability"] == pytest.approx(ratio / (99 + ratio))


def test_likelihood_ratio_column(spark):
    rows = spark.createDataFrame([("VELOCITY", "CRITICAL"), ("VELOCITY", "LOW")], "r string, s string")
    got = [x[0] for x in rows.select(likelihood_ratio(F.col("r"), F.col("s"), ScoringConfig())).collect()]
    assert got == [300.0, 1.3]


def test_both_forms_of_the_score_agree(spark):
    rows = [txn(OFF_HOURS, "20000", category=c, customer=c) for c in ("GAMBLING", "CRYPTO", "RETAIL")]
    assessed = assess(frame(spark, rows), merchants(spark))
    again = score(assessed.select("transaction_id", "violations"))
    pairs = assessed.join(again.withColumnRenamed("fraud_probability", "p"), "transaction_id").select("fraud_probability", "p")
    assert all(a == pytest.approx(b) for a, b in pairs.collect())


def test_more_evidence_never_lowers_the_score(spark):
    keys = list(LIKELIHOOD_RATIOS)
    got = scored(spark, {str(n): [tuple(k.split(":")) for k in keys[:n]] for n in range(len(keys) + 1)})
    scores = [got[str(n)]["risk_score"] for n in range(len(keys) + 1)]
    assert scores == sorted(scores)


def test_failing_python_rule_is_a_pass_for_its_rows_only(spark):
    def check(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["merchant_id"] == "BAD").any():
            raise RuntimeError("no such merchant")
        hit = batch["amount"].astype(float) > 50
        return pd.DataFrame({"severity": hit.map({True: "LOW", False: None}), "description": "above 50"})

    rules = register_rule(python_rule("ABOVE_FIFTY", 30, ["merchant_id", "amount"], check))
    rows = [txn(amount="60", customer="over"), txn(amount="40", customer="under"),
            txn(OFF_HOURS, "60", merchant="BAD", customer="fails")]
    got = {r["customer_id"]: r for r in assess(frame(spark, rows), merchants(spark), rules=rules).collect()}
    assert [v["rule_name"] for v in got["over"]["violations"]] == ["ABOVE_FIFTY"]
    assert got["under"]["violations"] == [] and got["under"]["rule_errors"] == []
    assert [v["rule_name"] for v in got["fails"]["violations"]] == ["TIME_OF_DAY_ANOMALY"]
    assert got["fails"]["rule_errors"] == ["ABOVE_FIFTY"]


def test_extreme_amounts_do_not_fail_the_job(spark):
    huge = "999999999999999.9999"
    rows = [txn(BUSINESS.replace(minute=m), huge) for m in range(12)]
    got = assess(frame(spark, rows), merchants(spark)).collect()
    assert len(got) == 12 and all(r["disposition"] == "FLAGGED" for r in got[1:])


def test_all_rules_disabled(spark):
    from swipewatch.operators.rules import RULES
    cfg = RuleConfig(disabled=frozenset(r.name for r in RULES))
    context = build_context(frame(spark, [txn(OFF_HOURS, "99999")]), merchants(spark), cfg)
    row = conclude(context, cfg).first()
    assert row["violations"] == [] and row["risk_score"] == 1 and row["disposition"] == "CLEARED"
    assert evaluate_rules(context, cfg).first()["violations"] == []
