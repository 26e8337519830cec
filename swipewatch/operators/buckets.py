"""Hourly and daily spend tables per customer and currency, and how they are kept up to date.

A stored table is a set of deltas: every batch of transactions adds its own sums per customer, currency and hour or day.
Rows of one key are merged by adding their columns, so nothing stored is ever rewritten, late transactions are one more
delta, and a reader may add deltas up in any order or leave that to the sum it takes anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipewatch.config import DAY, HOUR
from swipewatch.functions.columns import amount_units, epoch_day, epoch_hour

# The widest sum of squares that is kept exactly. One that does not fit is stored as this; with two rows or more it then
# does not fit the variance either, which is taken from ``rough`` instead.
WIDEST = "99999999999999999999999999999999999999"
_KEYS = [T.StructField("customer_id", T.StringType()), T.StructField("currency", T.StringType())]
HOURLY = T.StructType([*_KEYS, T.StructField("epoch_hour", T.LongType()), T.StructField("spend", T.DecimalType(29, 4)),
                       T.StructField("epoch_day", T.LongType())])
DAILY = T.StructType([*_KEYS, T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(29, 4)),
                      T.StructField("squares", T.DecimalType(38, 0)), T.StructField("rough", T.DoubleType()),
                      T.StructField("epoch_day", T.LongType())])


def hourly_buckets(txns: DataFrame) -> DataFrame:
    return (txns.groupBy("customer_id", "currency", epoch_hour(F.unix_micros("timestamp")).alias("epoch_hour"))
            .agg(F.sum("amount").alias("spend")))


def daily_buckets(txns: DataFrame) -> DataFrame:
    amount = F.col("amount").cast("double")
    return (txns.groupBy("customer_id", "currency", epoch_day(F.unix_micros("timestamp")).alias("epoch_day"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.sum(amount * amount).alias("squares")))


def windowed_spend(txns: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """The same sums as a tumbling event-time window, for batch or stream. Late rows are only
    dropped if a ``watermark`` is asked for."""
    if watermark:
        txns = txns.withWatermark("timestamp", watermark)
    return (txns.groupBy("customer_id", "currency", F.window("timestamp", width).alias("w"))
            .agg(F.sum("amount").alias("spend"), F.count(F.lit(1)).alias("n"))
            .select("customer_id", "currency", F.col("w.start").alias("starts_at"), "spend", "n"))


# --- stored tables ------------------------------------------------------------------------------

def hourly_delta(txns: DataFrame) -> DataFrame:
    hour = epoch_hour(F.unix_micros("timestamp")).alias("epoch_hour")
    return (txns.groupBy("customer_id", "currency", hour).agg(F.sum("amount").cast("decimal(29,4)").alias("spend"))
            .withColumn("epoch_day", F.expr("epoch_hour div 24") - F.expr("cast(epoch_hour % 24 < 0 as bigint)")))


def daily_delta(txns: DataFrame) -> DataFrame:
    """Count, sum and sum of squares; squares in whole smallest units, and once more as doubles of no bound."""
    units = amount_units(F.col("amount"))
    rough = units.cast("double")
    return (txns.groupBy("customer_id", "currency", epoch_day(F.unix_micros("timestamp")).alias("epoch_day"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(29,4)").alias("total"),
                 F.coalesce(F.try_sum(F.try_multiply(units, units)), F.lit(WIDEST).cast("decimal(38,0)")).alias("squares"),
                 F.sum(rough * rough).alias("rough"))
            .select(*DAILY.fieldNames()))


def add_deltas(txns: DataFrame, folder: str, batch: str) -> None:
    """Adds one batch of transactions to the tables under ``folder``. A batch is a set of folders of its own, by day, and
    writing it again replaces it, so a repeated job counts nothing twice."""
    for name, delta in (("hourly", hourly_delta(txns)), ("daily", daily_delta(txns))):
        (delta.hint("rebalance", "epoch_day").write.mode("overwrite").partitionBy("epoch_day")
         .parquet(f"{folder.rstrip('/')}/{name}/batch={batch}"))


def read_deltas(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(hourly, daily)`` of all batches; days prune folders."""
    batch = T.StructField("batch", T.StringType())
    read = lambda name, kind: spark.read.schema(T.StructType([*kind.fields, batch])).parquet(f"{folder.rstrip('/')}/{name}")
    return read("hourly", HOURLY).drop("batch"), read("daily", DAILY).drop("batch")


def merged(hourly: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per key; adding up deltas and merging them commute."""
    wide = F.coalesce(F.try_sum("squares"), F.lit(WIDEST).cast("decimal(38,0)")).alias("squares")
    return (hourly.groupBy("customer_id", "currency", "epoch_hour", "epoch_day").agg(F.sum("spend").cast("decimal(29,4)").alias("spend"))
            .select(*HOURLY.fieldNames()),
            daily.groupBy("customer_id", "currency", "epoch_day").agg(
                F.sum("n").alias("n"), F.sum("total").cast("decimal(29,4)").alias("total"), wide, F.sum("rough").alias("rough"))
            .select(*DAILY.fieldNames()))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """All deltas under ``folder`` merged into a single batch of the tables under ``target``, day by day."""
    for name, table in zip(("hourly", "daily"), merged(*read_deltas(spark, folder))):
        (table.hint("rebalance", "epoch_day").write.mode("overwrite").partitionBy("epoch_day")
         .parquet(f"{target.rstrip('/')}/{name}/batch=compacted"))


def carried_rows(hourly: DataFrame, daily: DataFrame, day: int, first_hour: int, days: int) -> DataFrame:
    """What the tables hold from before ``day`` and inside the windows of its transactions, as rows that add to running
    totals: hours from ``first_hour`` on to ``day_w``, days of the last ``days`` to ``base_*``. Both bounds prune folders."""
    hours = (hourly.where((F.col("epoch_day") >= F.lit(first_hour // 24)) & (F.col("epoch_day") < day) & (F.col("epoch_hour") >= first_hour))
             .select("customer_id", "currency", (F.col("epoch_hour") * F.lit(HOUR)).alias("us"), F.col("spend").alias("day_w")))
    whole = (daily.where((F.col("epoch_day") > day - days) & (F.col("epoch_day") < day))
             .select("customer_id", "currency", (F.col("epoch_day") * F.lit(DAY)).alias("us"), F.col("n").alias("base_n"),
                     F.col("total").alias("base_s"), F.col("squares").alias("base_q"), F.col("rough").alias("base_r")))
    return hours.unionByName(whole, allowMissingColumns=True)
