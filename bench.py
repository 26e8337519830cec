"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from swipewatch.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "assess", "assess_bucketed", "assess_incremental", "assess_from_buckets", "context_bundle", "evaluate_rules", "baseline_exact", "daily_spend_bucketed",
    "dedupe_transactions", "quarantine", "fraud_summary", "customer_risk_summary", "merchant_risk_summary",
    "feed_flagged", "feed_customer_history", "feed_pages", "outcome_status", "detection_metrics",
)


def run(result) -> float:
    start = time.perf_counter()
    result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def fixed_control(spark, folder):
    """Never changes and uses nothing of the package: tells a slower machine from slower code when rounds are compared."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.groupBy("l_suppkey", "l_returnflag").agg({"l_quantity": "sum", "l_extendedprice": "max"}).orderBy("l_suppkey", "l_returnflag")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("swipewatch-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    for name in HEADLINE:
        run(QUERIES[name](spark, folder))  # compile, and store the assessments once
    each, control = {name: [] for name in HEADLINE}, []
    for k in range(3):  # another order every time, so that no query always follows the same one
        shift = k * len(HEADLINE) // 3
        for name in HEADLINE[shift:] + HEADLINE[:shift]:
            start = time.perf_counter()
            run(QUERIES[name](spark, folder))
            each[name].append(time.perf_counter() - start)
        control.append(run(fixed_control(spark, folder)))
    times = {name: round(median(found), 3) for name, found in each.items()}
    print(json.dumps({
        "metric": "total of the median seconds of the headline queries, planning included", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "control_sec": round(median(control), 3), "transactions": rows, "assessed_per_second": round(rows / times["assess"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
