"""The scoring stream: raw events in, assessments and one output per verdict out."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from swipewatch.config import RuleConfig, ScoringConfig
from swipewatch.operators.context import (FEATURES, counts_from_recent, effective_location, features_from_recent,
                                          moments)
from swipewatch.operators.rules import RULES
from swipewatch.plans.assess import conclude
from swipewatch.schemas import TRANSACTION
from swipewatch.sources import ingest, tables
from swipewatch.streaming.activity import HISTORY, CustomerActivity
from swipewatch.streaming.commits import write_batch
from swipewatch.streaming.metrics import batch_metrics

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checked(raw: DataFrame, max_future_skew: str | None = None) -> DataFrame:
    """Normalised events with ``errors``. An event far ahead of its arrival pushes a customer's whole history out
    of the windows; ``max_future_skew`` rejects such events."""
    events = ingest.with_stream_errors(ingest.normalise_events(raw))
    if max_future_skew is None:
        return events
    ahead = F.coalesce(F.col("timestamp") > F.col("ingest_ts") + F.expr(f"INTERVAL '{max_future_skew}'"), F.lit(False))
    problem = F.array(F.struct(F.lit("timestamp").alias("field"), F.lit("too far in the future").alias("message")))
    return events.withColumn("errors", F.when(ahead, F.concat("errors", problem)).otherwise(F.col("errors")))


def once(valid: DataFrame) -> DataFrame:
    """Each id once, whatever its age and whichever customer it comes under: an index of all ids taken so far, dealt out by
    the id's hash and looked up by key, before anything is dealt out by customer. It never forgets, as ids are unique for
    good, and holds an id and nothing else of a transaction."""
    return valid.select(*TRANSACTION.fieldNames()).dropDuplicates(["transaction_id"])


def with_history(new: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Each transaction with its customer's history; partitioned and stateful by customer.

    The state lets go of a customer's buckets once they have not been written for longer than any window.
    """
    return new.select(*TRANSACTION.fieldNames()).groupBy("customer_id").transformWithState(
        statefulProcessor=CustomerActivity(cfg), outputStructType=HISTORY, outputMode="Append",
        timeMode="ProcessingTime")


def context_from_history(history: DataFrame, merchants: DataFrame, cfg: RuleConfig) -> DataFrame:
    mean, deviation = moments(F.col("baseline_count"), F.col("baseline_total"), F.col("baseline_squares"),
                              F.col("baseline_rough"))
    rows = effective_location(history, merchants).withColumns({"baseline_mean": mean, "baseline_stddev": deviation})
    full = features_from_recent(counts_from_recent(rows, cfg), cfg, ordered_before=False)
    return full.select(*TRANSACTION.fieldNames(), "us", "effective_latitude", "effective_longitude", *FEATURES)


def start_scoring(raw: DataFrame, load_merchants: Callable[[], DataFrame], folder: str, *,
                  rule_cfg: RuleConfig | None = None, scoring_cfg: ScoringConfig | None = None, rules=RULES,
                  assessed_at: Column | None = None, max_future_skew: str | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Scores a stream into ``folder``/assessments, ``folder``/routed/<verdict> and ``folder``/metrics.

    The outputs of a micro-batch become visible together, once; read them with :func:`swipewatch.streaming.commits.read_output`.
    Merchants are loaded anew for every micro-batch. Arrivals, rejects and repeats are counted on the way, for
    :class:`swipewatch.streaming.metrics.StreamCounters`.
    """
    rule_cfg, scoring_cfg = rule_cfg or RuleConfig(), scoring_cfg or ScoringConfig()
    at = F.current_timestamp() if assessed_at is None else assessed_at

    def sink(batch: DataFrame, batch_id: int) -> None:
        def outputs(store):
            context = context_from_history(batch, load_merchants(), rule_cfg)
            # The other outputs come from what was just stored, so they cannot disagree with it.
            written = store("assessments", conclude(context, rule_cfg, scoring_cfg, rules, at))
            for verdict, rows in tables.route(written).items():
                store(tables.join_path("routed", verdict.lower()), rows)
            store("metrics", batch_metrics(written))

        write_batch(batch, batch_id, folder, outputs)

    events = checked(raw, max_future_skew).observe(
        "arrivals", F.count(F.lit(1)).alias("arrived"), F.count_if(F.size("errors") > 0).alias("rejected"))
    new = once(events.where(F.size("errors") == 0)).observe("taken", F.count(F.lit(1)).alias("taken"))
    writer = (with_history(new, rule_cfg).writeStream.queryName("scoring")
              .option("checkpointLocation", tables.join_path(folder, "checkpoints", "scoring"))
              .foreachBatch(sink).trigger(**(trigger or {"availableNow": True})))
    with session_settings(raw.sparkSession, {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # State expires by running time, and there are no timers: batches without data would only keep the stream awake.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }):
        return writer.start()


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """Settings for what is started inside; a query keeps a copy, and the session has its own back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def start_quarantine(raw: DataFrame, folder: str, *, max_future_skew: str | None = None,
                     trigger: dict | None = None) -> StreamingQuery:
    """Writes rejected events to ``folder``/quarantine. The file sink itself is exactly-once."""
    rejected = ingest.quarantine(checked(raw, max_future_skew).where(F.size("errors") > 0)).drop("errors")
    return (rejected.writeStream.queryName("quarantine").format("parquet")
            .option("path", tables.join_path(folder, "quarantine"))
            .option("checkpointLocation", tables.join_path(folder, "checkpoints", "quarantine"))
            .trigger(**(trigger or {"availableNow": True})).start())


def as_raw_events(txns: DataFrame) -> DataFrame:
    """Transactions in wire form, arriving one second after they happened."""
    return txns.select(
        "transaction_id", "customer_id", "merchant_id", F.col("amount").cast("string").alias("amount"), "currency",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("category", "location")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("latitude", "longitude")],
        F.coalesce("device_fingerprint", F.lit("")).alias("device_fingerprint"),
        "timestamp", "transaction_type", F.expr("timestamp + INTERVAL 1 SECOND").alias("ingest_ts"))


def replay(spark: SparkSession, txns: DataFrame, merchants: DataFrame, folder: str,
           rule_cfg: RuleConfig | None = None, slice_days: int = 7, again: DataFrame | None = None) -> str:
    """Feeds stored transactions through the stream, one time slice after the other; returns the
    stream's folder. Between slices the stream stops and restarts from its checkpoint.
    ``again`` is delivered once more at the end."""
    inbox = tables.join_path(folder, "inbox")
    day = F.unix_date(F.to_date("timestamp"))
    low, high = txns.agg(F.min(day), F.max(day)).first()
    slices = [txns.where(day.between(start, start + slice_days - 1)) for start in range(low, high + 1, slice_days)]
    for part in [*slices, *([] if again is None else [again])]:
        as_raw_events(part).write.mode("append").parquet(inbox)
        start_scoring(tables.stream_transactions(spark, inbox), lambda: merchants, folder, rule_cfg=rule_cfg,
                      assessed_at=F.col("timestamp")).awaitTermination()
    return folder
