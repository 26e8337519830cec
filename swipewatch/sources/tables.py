"""Where rows come from and where they go."""

from __future__ import annotations

import math
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipewatch import schemas
from swipewatch.schemas import CLEARED, FLAGGED, PENDING_REVIEW

RETENTION_DAYS = 91  # fixed value
ROWS_PER_TASK = 100_000  # with what windows and sorts add to them some 200 MB


# --- session and shared folder ------------------------------------------------------------------

def prepare_session(spark: SparkSession) -> SparkSession:
    """Run-time settings the package relies on. Leaves sizing and cluster settings alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Wide projections would otherwise compile into one method the JIT refuses.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may do without the setting; it uses the
    warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return join_path(spark.conf.get("spark.sql.warehouse.dir"), "scratch")


def join_path(folder: str, *parts: str) -> str:
    return "/".join([folder.rstrip("/"), *parts])


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """Rows by ``keys`` for windows, in tasks of about ``ROWS_PER_TASK``, of ``count`` rows altogether.

    Left to itself adaptive execution merges partitions by their packed bytes, and rows that pack well then meet in
    a few tasks whose memory grows with the input. So their number is set, the session's being the least.
    """
    tasks = math.ceil(count / ROWS_PER_TASK)
    if tasks <= 1:
        return rows.repartition(*keys)
    return rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


# --- reading ------------------------------------------------------------------------------------

def scan_transactions(spark: SparkSession, path: str, from_date: date | None = None,
                      to_date: date | None = None) -> DataFrame:
    """Transactions with the declared schema; dates prune the daily partitions of a partitioned table."""
    declared = schemas.TRANSACTION
    if from_date is not None or to_date is not None:
        declared = T.StructType([*declared.fields, T.StructField("event_date", T.DateType())])
    frame = spark.read.schema(declared).parquet(path)
    if from_date is not None:
        frame = frame.where(F.col("event_date") >= F.lit(from_date))
    if to_date is not None:
        frame = frame.where(F.col("event_date") <= F.lit(to_date))
    return frame.drop("event_date")


def stream_transactions(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Raw events arriving as files. Unreadable JSON lines come through as all-NULL rows for validation to reject."""
    reader = spark.readStream.schema(schemas.RAW_EVENT)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Raw events from a Kafka topic with JSON values, oldest first, committed records only.

    Needs the Kafka connector on the class path.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed"))
    for name, value in options.items():
        reader = reader.option(name, value)
    payload = [name for name in schemas.RAW_EVENT.fieldNames() if name != "ingest_ts"]
    parsed = F.from_json(F.col("value").cast("string"), schemas.RAW_EVENT, {"mode": "PERMISSIVE"})
    return reader.load().select(parsed.alias("e"), F.col("timestamp").alias("ingest_ts")).select(
        *[f"e.{name}" for name in payload], "ingest_ts")


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MERCHANT_LOCATION).parquet(path)


# --- shaping outputs ----------------------------------------------------------------------------

def explode_violations(assessments: DataFrame) -> DataFrame:
    """One row per violation, keyed by assessment."""
    return (assessments.select("assessment_id", "transaction_id", F.posexplode("violations").alias("position", "v"))
            .select("assessment_id", "transaction_id", "position", "v.*"))


def route(assessments: DataFrame) -> dict[str, DataFrame]:
    """One frame per verdict, each with the columns its readers get. Keyed by ``customer_id``."""
    amount = F.col("amount").cast("string").alias("amount")
    kind = F.coalesce("transaction_type", F.lit(schemas.CARD_NOT_PRESENT)).alias("transaction_type")
    shapes = {
        FLAGGED: ["transaction_id", "customer_id", "risk_score", "assessed_at"],
        PENDING_REVIEW: ["transaction_id", "customer_id", "merchant_id", amount, "currency", kind,
                         "risk_score", "assessed_at"],
        CLEARED: ["transaction_id", "customer_id", "merchant_id", amount, "currency", kind, "timestamp"],
    }
    return {verdict: assessments.where(F.col("disposition") == verdict).select(*columns)
            for verdict, columns in shapes.items()}


# --- writing ------------------------------------------------------------------------------------

def bloom_filters(writer: DataFrameWriter, *columns: str) -> DataFrameWriter:
    """Parquet Bloom filters on ids, so that a lookup by id skips the row groups that do not hold it. Their size follows
    the number of ids in a row group."""
    for column in columns:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                  .option(f"parquet.bloom.filter.adaptive.enabled#{column}", "true").option(f"parquet.enable.dictionary#{column}", "false"))
    return writer


def write_assessments(assessments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested assessments by verdict, in time order inside each file so time filters skip row groups, with Bloom filters
    for lookups by either id."""
    (bloom_filters(assessments.sortWithinPartitions("assessed_at", "assessment_id").write.mode(mode), "transaction_id", "assessment_id")
     .partitionBy("disposition").parquet(path))


def read_assessments(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_daily_partitions(txns: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Daily partitions by event time. Days are rebalanced by size: small ones share a task, a busy one is
    split over as many as its bytes call for."""
    dated = txns.withColumn("event_date", F.to_date("timestamp"))
    (bloom_filters(dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "customer_id", "timestamp").write.mode(mode),
                   "transaction_id").partitionBy("event_date").parquet(path))


def split_retention(txns: DataFrame, as_of: date, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(active, archived). Days up to ``as_of - days`` leave the active set; nothing is dropped."""
    oldest = F.lit(as_of - timedelta(days=days))
    day = F.col("event_date") if "event_date" in txns.columns else F.to_date("timestamp")
    return txns.where(day > oldest), txns.where(day <= oldest)


def archive_expired(spark: SparkSession, table: str, archive: str, as_of: date, days: int = RETENTION_DAYS) -> list[str]:
    """Moves expired daily partitions of ``table`` under ``archive``; returns the days moved.

    A rename per partition through the file system Spark itself uses: no rows are read. Where the archive has the
    day already, its files are added one by one, and a name that is taken gets a new one. A rename that fails raises.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source = hadoop.Path(table)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cutoff = (as_of - timedelta(days=days)).isoformat()
    moved = []
    for entry in files.listStatus(source):
        name = entry.getPath().getName()
        day = name.removeprefix("event_date=")
        if name.startswith("event_date=") and day <= cutoff:
            target = hadoop.Path(join_path(archive, name))
            if not files.exists(target):
                files.mkdirs(target.getParent())
                _rename(files, entry.getPath(), target)
            else:
                for file in files.listStatus(entry.getPath()):
                    own = file.getPath().getName()
                    if files.exists(hadoop.Path(target, own)):
                        own = f"{uuid.uuid4().hex}-{own}"
                    _rename(files, file.getPath(), hadoop.Path(target, own))
                files.delete(entry.getPath(), False)
            moved.append(day)
    return sorted(moved)


def _rename(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"could not move {source.toString()} to {target.toString()}")
