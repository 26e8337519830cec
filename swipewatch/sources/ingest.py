"""Wire events to clean, unique transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipewatch.schemas import AMOUNT, CARD_NOT_PRESENT, PHYSICAL_TYPES, TRANSACTION_TYPES

# Column widths, the submit profile's patterns, and the delivery attempts before quarantine.
MAX_LENGTH = {"customer_id": 64, "merchant_id": 64, "currency": 3, "category": 64, "location": 128,
              "device_fingerprint": 128}
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
CURRENCY_PATTERN = "^[A-Z]{3}$"
ATTEMPTS = 3


def _none_if(column: str, absent) -> Column:
    return F.when(F.col(column) != absent, F.col(column))


def normalise_events(raw: DataFrame) -> DataFrame:
    """Typed columns from wire columns. What cannot be read becomes NULL, for :func:`validate` to name.

    Empty text and a 0.0 coordinate mean absent, each coordinate on its own. A
    missing event time becomes the arrival time.
    """
    typed = {
        "transaction_id": F.when(F.col("transaction_id").rlike(UUID_PATTERN), F.lower("transaction_id")),
        "amount": F.col("amount").try_cast(AMOUNT),
        "category": _none_if("category", ""),
        "location": _none_if("location", ""),
        "device_fingerprint": _none_if("device_fingerprint", ""),
        "latitude": _none_if("latitude", 0.0),
        "longitude": _none_if("longitude", 0.0),
        "timestamp": F.coalesce("timestamp", "ingest_ts"),
        "transaction_type": F.when(F.col("transaction_type").isin(*PHYSICAL_TYPES), F.col("transaction_type"))
        .otherwise(CARD_NOT_PRESENT),
    }
    return raw.select(
        *[typed[c].alias(c) if c in typed else c for c in raw.columns],
        F.col("transaction_id").alias("sent_transaction_id"), F.col("amount").alias("sent_amount"))


def _problems(checks: list[tuple[str, Column, str]]) -> Column:
    none = F.expr("cast(array() as array<struct<field:string,message:string>>)")
    return F.concat(none, *[
        F.when(failed, F.array(F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))).otherwise(none)
        for field, failed, message in checks])


def _lengths() -> list[tuple[str, Column, str]]:
    return [(field, F.coalesce(F.length(field) > size, F.lit(False)), f"longer than {size}")
            for field, size in MAX_LENGTH.items()]


def with_stream_errors(events: DataFrame) -> DataFrame:
    """Adds ``errors`` to normalised events: only what would fail on the stream path."""
    required = [(field, F.col(field).isNull(), "missing") for field in ("customer_id", "merchant_id", "currency")]
    return events.withColumn("errors", _problems([
        ("transaction_id", F.col("transaction_id").isNull(), "not a UUID"),
        ("amount", F.col("amount").isNull(), "not a number of at most 15 and 4 digits"),
        *required, *_lengths(),
        ("timestamp", F.col("timestamp").isNull(), "missing"),
    ]))


def with_submit_errors(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` to submit requests, whose ``amount`` is text. The stricter profile."""
    def empty(field):
        return F.col(field).isNull() | ~F.col(field).rlike(r"\S")

    amount = F.col("amount").try_cast("decimal(38,10)")
    latitude, longitude = F.col("latitude"), F.col("longitude")
    return requests.withColumn("_amount", amount).withColumn("errors", _problems([
        ("transaction_id", F.coalesce(~F.col("transaction_id").rlike(UUID_PATTERN), F.lit(False)), "not a UUID"),
        ("customer_id", empty("customer_id"), "must not be blank"),
        ("merchant_id", empty("merchant_id"), "must not be blank"),
        ("amount", F.col("_amount").isNull(), "must be a number"),
        ("amount", F.coalesce(F.col("_amount") <= 0, F.lit(False)), "must be greater than 0"),
        ("amount", F.coalesce((F.abs("_amount") >= F.lit(10 ** 15)) | (F.col("_amount") != F.round("_amount", 4)),
                              F.lit(False)), "at most 15 integer and 4 fraction digits"),
        ("currency", F.col("currency").isNull() | ~F.col("currency").rlike(CURRENCY_PATTERN),
         "must be a 3-letter uppercase code"),
        ("transaction_type", F.coalesce(~F.col("transaction_type").isin(*TRANSACTION_TYPES), F.lit(False)),
         "unknown transaction type"),
        ("latitude", F.coalesce(~latitude.between(-90.0, 90.0), F.lit(False)), "must lie within -90 and 90"),
        ("longitude", F.coalesce(~longitude.between(-180.0, 180.0), F.lit(False)), "must lie within -180 and 180"),
        *[check for check in _lengths() if check[0] != "currency"],
    ])).drop("_amount")


def validate(events: DataFrame, profile: str = "stream") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Rejected rows keep ``errors``; valid ones lose it."""
    if profile == "stream":
        checked = with_stream_errors(events)
    elif profile == "submit":
        checked = with_submit_errors(events)
    else:
        raise ValueError(f"profile must be 'stream' or 'submit', not {profile!r}")
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def quarantine(rejected: DataFrame) -> DataFrame:
    """Dead-letter shape: one text reason, and the attempts the delivery is worth.

    A broken row stays broken, so it is not retried here; Spark's task retries
    cover passing failures.
    """
    reason = F.concat_ws("; ", F.transform("errors", lambda e: F.concat_ws(": ", e.field, e.message)))
    return rejected.withColumns({"reason": reason, "attempts": F.lit(ATTEMPTS), "status": F.lit("FAILED")})


def dedupe(events: DataFrame, known: DataFrame | None = None,
           order: tuple[str, ...] = ("ingest_ts",)) -> tuple[DataFrame, DataFrame]:
    """(first deliveries, repeats). The first by ``order`` wins; ``repeats`` counts the others per id.

    An aggregate, not a window: copies of one id are combined before the
    shuffle, so an id delivered millions of times costs one row per task.
    ``known`` holds ids assessed earlier; those are repeats altogether.
    """
    payload = [c for c in events.columns if c not in order and c != "transaction_id"]
    firsts = (
        events.groupBy("transaction_id")
        .agg(F.min(F.struct(*order, *payload)).alias("first"), F.count(F.lit(1)).alias("deliveries"))
    )
    repeats = firsts.select("transaction_id", (F.col("deliveries") - 1).alias("repeats"))
    if known is not None:
        seen = known.select("transaction_id").distinct().withColumn("_seen", F.lit(True))
        firsts = firsts.join(seen.drop("_seen"), "transaction_id", "left_anti")
        repeats = repeats.join(seen, "transaction_id", "left").select(
            "transaction_id", (F.col("repeats") + F.when(F.col("_seen"), 1).otherwise(0)).alias("repeats"))
    new = firsts.select(*[F.col("transaction_id") if c == "transaction_id" else F.col(f"first.{c}").alias(c)
                          for c in events.columns])
    return new, repeats.where(F.col("repeats") > 0)


def stored_assessments(resubmitted: DataFrame, assessments: DataFrame) -> DataFrame:
    """The stored assessment for every distinct resubmitted id; nothing is assessed again."""
    return assessments.join(resubmitted.select("transaction_id").distinct(), "transaction_id", "left_semi")


def assign_missing_ids(requests: DataFrame, natural_key: list[str] | None = None) -> DataFrame:
    """Keeps the caller's id, else makes one: random, or repeatable from ``natural_key``."""
    if natural_key:
        digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural_key]), 256)
        fresh = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
                            F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    else:
        fresh = F.uuid()
    return requests.withColumn("transaction_id", F.coalesce(_none_if("transaction_id", ""), fresh))


def transaction_status(txns: DataFrame, assessments: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """Adds ``status``: ASSESSED, FAILED or PENDING."""
    done = assessments.select("transaction_id", F.lit(True).alias("_assessed"))
    marked = txns.join(done, "transaction_id", "left")
    failed = F.lit(False)
    if quarantined is not None:
        marked = marked.join(
            quarantined.groupBy("transaction_id").agg(F.lit(True).alias("_failed")), "transaction_id", "left")
        failed = F.coalesce("_failed", F.lit(False))
    status = F.when(F.col("_assessed"), "ASSESSED").when(failed, "FAILED").otherwise("PENDING")
    return marked.withColumn("status", status).drop("_assessed", "_failed")
