"""Analyst decisions: recorded once, first writer wins.

``resolve_outcomes`` takes a whole table of requests to a whole table of assessments. Decisions that come in over time
go to a log instead: a batch of requests reads the parts of the log its ids fall in and adds what it decides. Assessments
are never rewritten; readers join the log, see ``with_outcomes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipewatch.schemas import CONFIRMED_FRAUD, FALSE_POSITIVE, UNRESOLVED

FINAL = (CONFIRMED_FRAUD, FALSE_POSITIVE)
SLOTS = 256  # parts of the log, by a hash of the transaction's id
LOG = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("event_id", T.StringType()),
    T.StructField("recorded_at", T.TimestampType()), T.StructField("batch", T.LongType()), T.StructField("slot", T.IntegerType())])


def winners(requests: DataFrame) -> DataFrame:
    """First valid request per transaction. Combined before the shuffle, however often one id was sent."""
    return (
        requests.where(F.col("outcome").isin(*FINAL)).groupBy("transaction_id")
        .agg(F.min(F.struct("recorded_at", "event_id", "outcome")).alias("w"))
        .select("transaction_id", F.col("w.event_id").alias("winning_event"), F.col("w.outcome").alias("winning_outcome"))
    )


def resolve_outcomes(assessments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assessments with outcomes, one status per request).

    Status: INVALID for anything but a final outcome, NOT_FOUND without an
    assessment, APPLIED for the first valid request of a still unresolved one,
    CONFLICT with the standing outcome for the rest.
    """
    first = winners(requests)
    open_ = F.col("outcome") == UNRESOLVED
    updated = assessments.join(first.select("transaction_id", "winning_outcome"), "transaction_id", "left").select(*[
        F.when(open_, F.coalesce("winning_outcome", "outcome")).otherwise(F.col("outcome")).alias("outcome")
        if c == "outcome" else F.col(c) for c in assessments.columns])
    standing = (
        assessments.select("transaction_id", F.col("outcome").alias("before"))
        .join(first, "transaction_id")
    )
    return updated, judged(requests, standing)


def judged(requests: DataFrame, standing: DataFrame) -> DataFrame:
    """One status per request, given ``before``, the outcome that stood, and the winner for every id that is assessed."""
    valid = F.coalesce(F.col("outcome").isin(*FINAL), F.lit(False))
    # One row per id on the right; Spark splits a request id that dominates the left.
    found = requests.join(standing, "transaction_id", "left").withColumn(
        "status", F.when(~valid, "INVALID").when(F.col("before").isNull(), "NOT_FOUND")
        .when((F.col("before") == UNRESOLVED) & (F.col("event_id") == F.col("winning_event")), "APPLIED")
        .otherwise("CONFLICT"))
    standing_outcome = F.when(F.col("before") != UNRESOLVED, F.col("before")).otherwise(F.col("winning_outcome"))
    return found.select(
        "event_id", "transaction_id", F.col("outcome").alias("requested"), "recorded_at", "status",
        F.when(F.col("status").isin("APPLIED", "CONFLICT"), standing_outcome).alias("standing_outcome"))


# --- the log --------------------------------------------------------------------------------------

def slot_of(transaction_id: Column) -> Column:
    return F.pmod(F.xxhash64(transaction_id), F.lit(SLOTS)).cast("int")


def read_log(spark: SparkSession, folder: str, before_batch: int | None = None) -> DataFrame:
    """Decisions of the log, one per transaction: that of the first batch. An absent folder is an empty log."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(folder)
    return log if before_batch is None else log.where(F.col("batch") < before_batch)


def record(requests: DataFrame, assessments: DataFrame, folder: str, batch: int) -> DataFrame:
    """Takes one batch of ``requests`` to the log in ``folder``; returns one status per request as ``resolve_outcomes`` does.

    Batches are numbered upwards; an earlier batch wins over a later one, and within a batch the first request does. A
    batch that is repeated, at once or later, decides the same again and replaces what it wrote. Of ``assessments`` only
    ids and outcomes are read, and of the log only the slots of the batch's ids.
    """
    spark = requests.sparkSession
    ids = requests.select("transaction_id").distinct().withColumn("slot", slot_of(F.col("transaction_id")))
    decided = (read_log(spark, folder, batch).join(ids, ["slot", "transaction_id"], "left_semi")
               .select("transaction_id", F.col("outcome").alias("logged")))
    known = assessments.join(ids.select("transaction_id"), "transaction_id", "left_semi").select("transaction_id", "outcome")
    standing = (known.join(decided, "transaction_id", "left").join(winners(requests), "transaction_id", "left")
                .select("transaction_id", F.coalesce("logged", "outcome").alias("before"), "winning_event", "winning_outcome"))
    statuses = judged(requests, standing)
    applied = statuses.where("status = 'APPLIED'").dropDuplicates(["transaction_id"])
    (applied.select("transaction_id", F.col("requested").alias("outcome"), "event_id", "recorded_at",
                    slot_of(F.col("transaction_id")).alias("slot"))
     .hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{folder.rstrip('/')}/batch={batch}"))
    return statuses


def with_outcomes(assessments: DataFrame, log: DataFrame) -> DataFrame:
    """Assessments with the outcomes of the log; columns as they came."""
    logged = log.select("transaction_id", F.col("outcome").alias("_logged"))
    return assessments.join(logged, "transaction_id", "left").select(*[
        F.when(F.col("outcome") == UNRESOLVED, F.coalesce("_logged", "outcome")).otherwise(F.col("outcome")).alias("outcome")
        if c == "outcome" else F.col(c) for c in assessments.columns])


def compact_log(spark: SparkSession, folder: str, target: str, upto: int) -> None:
    """All batches up to ``upto`` as one batch of that number in a log under ``target``, slot by slot."""
    (read_log(spark, folder, upto + 1).drop("batch").hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot")
     .parquet(f"{target.rstrip('/')}/batch={upto}"))
