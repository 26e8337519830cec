"""Card transactions derived from the ``events`` test table.

The test data holds no card transactions, so each event becomes one: every week
of events is squeezed into one hour per user, which makes the short activity
windows meaningful. Whole-number arithmetic only, so any SQL engine agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipewatch import schemas
from swipewatch.config import HOUR

# Fixed values.
EPOCH_2024 = 1_704_067_200_000_000
WEEK = 604_800_000_000
MERCHANTS = (
    ("MERCH-00", 38.7223, -9.1393, "Lisbon", "PT"),
    ("MERCH-01", 52.2297, 21.0122, "Warsaw", "PL"),
    ("MERCH-02", 37.9838, 23.7275, "Athens", "GR"),
    ("MERCH-03", 48.2082, 16.3738, "Vienna", "AT"),
    ("MERCH-04", 59.9139, 10.7522, "Oslo", "NO"),
    ("MERCH-05", 53.3498, -6.2603, "Dublin", "IE"),
)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")


def merchants(spark: SparkSession) -> DataFrame:
    """A literal relation, so Spark knows its size when it plans the join."""
    rows = ", ".join(f"('{m}', {lat}D, {lon}D, '{city}', '{country}')" for m, lat, lon, city, country in MERCHANTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(merchant_id, latitude, longitude, city, country)")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event, plus ``event_id`` and ``k`` for deriving further inputs.

    ``ts`` carries no time zone and counts as UTC, so the session must run in UTC.
    """
    k = F.col("k")
    step = F.expr("d div 604800000000")
    base = (
        read_events(spark, sf_dir)
        .select(
            "event_id", "user_id", "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.floor(F.col("value") / 10).cast("int").alias("b"),
            (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_2024).alias("d"),
        )
    )
    us = (F.lit(EPOCH_2024) + step * WEEK + F.pmod("user_id", F.lit(24)) * HOUR
          + F.expr("(d % 604800000000) div 168"))
    home = F.pmod("user_id", F.lit(3))

    def place(away, first, second, third):
        return (F.when(k % 20 == 0, F.lit(None).cast("double"))
                .when(k % 50 == 1, away).when(home == 0, first)
                .when(home == 1, second).otherwise(third))

    category = (
        F.when(k % 8 == 1, "RETAIL").when(k % 8 == 2, "GROCERY").when(k % 8 == 3, "FUEL")
        .when(k % 8 == 4, "DINING")
        .when(k % 16 == 5, "CRYPTO_EXCHANGE").when(k % 8 == 5, "PHARMACY")
        .when(k % 16 == 6, "GAMBLING").when(k % 8 == 6, "TRAVEL")
        .when(k % 32 == 7, "WIRE_TRANSFER").when(k % 8 == 7, "ELECTRONICS")
    )
    kind = (F.when(F.col("event_type") == "signup", "CONTACTLESS")
            .when(F.col("event_type") == "purchase", "CARD_PRESENT")
            .when(F.col("event_type") == "error", "ATM").otherwise("CARD_NOT_PRESENT"))
    device = (F.when(k % 5 < 3, F.lit(None).cast("string"))
              .when(k % 40 == 4, F.concat(F.lit("dev-new-"), F.col("event_id").cast("string")))
              .otherwise(F.concat(F.lit("dev-"), F.col("user_id").cast("string"))))
    return base.select(
        F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
        .alias("transaction_id"),
        F.concat(F.lit("CUST-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("customer_id"),
        F.concat(F.lit("MERCH-"), F.lpad((k % 12).cast("string"), 2, "0")).alias("merchant_id"),
        (F.col("b") * 150 + 9).cast(schemas.AMOUNT).alias("amount"),
        F.when(k % 10 == 0, "USD").otherwise("ZAR").alias("currency"),
        category.alias("category"),
        F.lit(None).cast("string").alias("location"),
        place(64.1466, 38.7223, 52.2297, 37.9838).alias("latitude"),
        place(-21.9426, -9.1393, 21.0122, 23.7275).alias("longitude"),
        device.alias("device_fingerprint"),
        F.timestamp_micros(us).alias("timestamp"),
        kind.alias("transaction_type"),
        "event_id", "k",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions as producers would send them, with some broken and some sent twice.

    The remainders only mark which rows are spoilt; every event is delivered.
    """
    n = F.col("event_id")
    sent = transactions(spark, sf_dir).select(
        "transaction_id", "customer_id", "merchant_id",
        F.when(n % 97 == 0, "not-a-number").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(n % 89 == 0, "TOOLONG").otherwise(F.col("currency")).alias("currency"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
        F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
        F.coalesce("device_fingerprint", F.lit("")).alias("device_fingerprint"),
        F.when(n % 79 != 0, F.col("timestamp")).alias("timestamp"),
        F.coalesce("transaction_type", F.lit("TRANSACTION_TYPE_UNSPECIFIED")).alias("transaction_type"),
        F.expr("timestamp + INTERVAL 1 SECOND").alias("ingest_ts"),
        F.explode(F.when(n % 83 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("delivery"),
    )
    return sent.withColumn(
        "ingest_ts", F.timestamp_micros(F.unix_micros("ingest_ts") + (F.col("delivery") - 1) * 1_000_000))


# What spoils a column, for every so many events: the value for each remainder, the first being 1.
SPOILT = {
    "transaction_id": (13, ("'nope'", "upper(transaction_id)", "NULL", "transaction_id || '0'")),
    "customer_id": (17, ("''", "'   '", "NULL", "repeat('c', 65)", "repeat('c', 64)")),
    "merchant_id": (19, ("''", "NULL", "repeat('m', 64)", "repeat('m', 65)", "chr(9)")),
    "amount": (23, ("'0'", "'-5.00'", "'abc'", "'1.23456'", "'1000000000000000'", "'999999999999999.9999'", "NULL", "''",
                    "'12345678901234567.0'", "'-1.23456'", "'0.00001'")),
    "currency": (29, ("'zar'", "'ZA'", "'ZARX'", "''", "NULL", "'Z1R'")),
    "transaction_type": (31, ("'WIRE'", "''", "NULL", "'card_present'")),
    "latitude": (37, ("90.0", "90.5", "-91.0", "NULL")),
    "longitude": (41, ("180.0", "180.5", "-200.0", "NULL")),
    "category": (43, ("repeat('k', 65)", "repeat('k', 64)")),
    "location": (47, ("repeat('l', 129)", "repeat('l', 128)")),
    "device_fingerprint": (53, ("repeat('d', 129)", "repeat('d', 128)")),
}


def spoilt_sql(column: str, kind: str) -> str:
    """The column with some of its values spoilt, as SQL text that Spark and other engines read alike."""
    every, values = SPOILT[column]
    cases = " ".join(f"WHEN {i} THEN CAST({value} AS {kind})" for i, value in enumerate(values, 1))
    return f"CASE event_id % {every} {cases} ELSE CAST({column} AS {kind}) END"


def spoilt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same transactions in wire form with every column spoilt in several ways, and ``event_id`` to name the rows."""
    sent = transactions(spark, sf_dir).withColumns({
        "amount": F.col("amount").cast("string"), **{c: F.coalesce(c, F.lit("")) for c in ("category", "location", "device_fingerprint")},
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("latitude", "longitude")}, "ingest_ts": F.expr("timestamp + INTERVAL 1 SECOND")})
    return sent.selectExpr(*[
        f"{spoilt_sql(c, 'DOUBLE' if c in ('latitude', 'longitude') else 'STRING')} AS {c}" if c in SPOILT else c
        for c in schemas.RAW_EVENT.fieldNames()], "event_id")


def outcome_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst decisions: one per tenth transaction, some repeated with the opposite value, some unknown."""
    n = F.col("event_id")
    first = (F.when(F.col("k") % 3 == 0, schemas.CONFIRMED_FRAUD)
             .when(F.col("k") % 3 == 1, schemas.FALSE_POSITIVE).otherwise(schemas.UNRESOLVED))
    opposite = (F.when(F.col("k") % 3 == 0, schemas.FALSE_POSITIVE).otherwise(schemas.CONFIRMED_FRAUD))
    target = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(
        (n + F.when(n % 50 == 0, 10_000_000).otherwise(0)).cast("string"), 12, "0"))
    calls = F.array_compact(F.array(
        F.when(n % 10 == 0, F.struct(F.lit(1).alias("hours"), first.alias("outcome"))),
        F.when(n % 20 == 0, F.struct(F.lit(2).alias("hours"), opposite.alias("outcome"))),
    ))
    return (
        transactions(spark, sf_dir)
        .select(n, "timestamp", target.alias("transaction_id"), F.explode(calls).alias("call"))
        .select(
            F.concat(n.cast("string"), F.lit("-"), F.col("call.hours").cast("string")).alias("event_id"),
            "transaction_id", F.col("call.outcome").alias("outcome"),
            F.timestamp_micros(F.unix_micros("timestamp") + F.col("call.hours") * F.lit(HOUR)).alias("recorded_at"),
        )
    )
