"""Operational figures of a running stream.

Counters of what was scored are rows ``(metric, tag, value)`` that every micro-batch stores next to its assessments;
rows of any number of batches merge by adding values. Latencies are counted in classes of one percent width, which
merge in the same way and from which any quantile follows to within one percent. What never reaches the
assessments, rejects and repeats, is counted inside the running query and handed to a listener with each batch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

WIDTH = math.log(1.01)  # of a latency class, on the logarithm of milliseconds


def batch_metrics(assessments: DataFrame) -> DataFrame:
    """``(metric, tag, value)``: assessments by verdict, violations and rule errors by rule, latency classes. One pass; the
    assessments are tagged before they are counted. Latency runs from the transaction's time to its assessment."""
    millis = F.greatest((F.unix_micros("assessed_at") - F.unix_micros("timestamp")) / 1000.0, F.lit(1.0))
    named = lambda metric, tag: F.struct(F.lit(metric).alias("metric"), tag.cast("string").alias("tag"))
    tags = F.concat(
        F.array(named("assessments", F.col("disposition")), named("latency_class", F.ceil(F.log(millis) / WIDTH))),
        F.transform(F.array_distinct(F.col("violations.rule_name")), lambda rule: named("violations", rule)),
        F.transform("rule_errors", lambda rule: named("rule_errors", rule)))
    return (assessments.select(F.explode(tags).alias("t")).groupBy("t.metric", "t.tag")
            .agg(F.count(F.lit(1)).alias("value")))


def merged(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric", "tag").agg(F.sum("value").alias("value"))


def latency_quantiles(metrics: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``(quantile, millis)`` from stored latency classes: the upper end of the class the quantile lies in. Classes are a
    few thousand at most, however long the stream ran; those alone are put in order."""
    classes = merged(metrics.where("metric = 'latency_class'")).select(F.col("tag").cast("long").alias("class"), "value")
    everything = Window.partitionBy()
    ranked = classes.select("class", F.sum("value").over(Window.orderBy("class")).alias("upto"), F.sum("value").over(everything).alias("n"))
    wanted = ranked.select("class", F.explode(F.array(*map(F.lit, quantiles))).alias("quantile"), "upto", "n")
    return (wanted.where(F.col("upto") >= F.col("quantile") * F.col("n")).groupBy("quantile")
            .agg(F.min("class").alias("class")).select("quantile", F.exp(F.col("class") * WIDTH).alias("millis")))


class StreamCounters(StreamingQueryListener):
    """Arrivals, rejects and repeats of the scoring stream since this listener was added."""

    def __init__(self):
        self.counts = {"arrived": 0, "rejected": 0, "taken": 0}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for row in event.progress.observedMetrics.values():
            for name, value in row.asDict().items():
                if name in self.counts:
                    self.counts[name] += value or 0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(metric, tag, value)`` like the stored counters."""
        c = self.counts
        return spark.createDataFrame([
            ("arrived", "", c["arrived"]), ("dead_letters", "", c["rejected"]),
            ("duplicate_deliveries", "", c["arrived"] - c["rejected"] - c["taken"])], "metric string, tag string, value long")


class BatchTimes(StreamingQueryListener):
    """Counts the micro-batches by query and duration, for latency percentiles over the whole run.

    Durations are kept to three digits, so a run of any length needs at most some thousand counters."""

    def __init__(self):
        self.batches: dict[tuple[str, int], list[int]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        millis = int(p.durationMs.get("triggerExecution", 0))
        step = 10 ** max(0, len(str(millis)) - 3)
        seen = self.batches.setdefault((p.name or "", millis // step * step), [0, 0])
        seen[0] += 1
        seen[1] += p.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def percentiles(self, spark: SparkSession) -> DataFrame:
        """p50, p95 and p99 of the micro-batch time per query. Times are per batch, not per transaction."""
        rows = spark.createDataFrame([(query, millis, *seen) for (query, millis), seen in self.batches.items()],
                                     "query string, millis long, batches long, input_rows long")
        return rows.groupBy("query").agg(
            F.sum("batches").alias("batches"), F.sum("input_rows").alias("input_rows"),
            *[F.percentile("millis", q, F.col("batches")).cast("long").alias(f"p{int(q * 100)}_millis") for q in (0.5, 0.95, 0.99)])
