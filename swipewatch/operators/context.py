"""Per-customer activity context as of each transaction.

A transaction sees the customer's earlier transactions, ordered by
(timestamp, transaction_id) and never itself. Ordinary customers are handled
here with one shuffle on ``customer_id``; the few customers too large for one
task go through :mod:`swipewatch.operators.hot`, which cuts their timeline.

Sliding sums are differences of two running totals, one up to the row and one up
to the start of its window. Both frames only ever grow, so a window of ninety
days costs no more per row than one of a minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipewatch.config import DAY, MINUTE, SECOND, RuleConfig, SkewConfig
from swipewatch.functions.columns import amount_units, epoch_day, epoch_hour, is_physical, too_fast_sql
from swipewatch.operators import hot as hot_customers
from swipewatch.schemas import CARD_NOT_PRESENT
from swipewatch.sources import tables

EXACT, BUCKETED = "exact", "bucketed"

TRANSACTION_FIELDS = (
    "transaction_id", "customer_id", "merchant_id", "amount", "currency", "category",
    "latitude", "longitude", "device_fingerprint", "timestamp", "transaction_type",
)
FEATURES = (
    "recent_count", "velocity_count", "cross_merchant_count", "duplicate_seen", "cloned_merchants",
    "known_devices", "device_known", "physical_count", "remote_count", "hourly_spend", "daily_spend",
    "baseline_count", "baseline_mean", "baseline_stddev", "conflict_latitude", "conflict_longitude",
)


def merchant_fallback(txns: DataFrame, merchants: DataFrame) -> DataFrame:
    """Adds ``merchant_latitude`` and ``merchant_longitude`` where the fallback applies.

    No broadcast hint: Spark broadcasts the dimension while it is small and
    falls back to a shuffled join, with skew splitting, once it is not.
    """
    dim = merchants.select(
        "merchant_id", F.col("latitude").alias("_dim_lat"), F.col("longitude").alias("_dim_lon"))
    applies = F.col("latitude").isNull() & ~F.col("transaction_type").eqNullSafe(CARD_NOT_PRESENT)
    return (
        txns.join(dim, "merchant_id", "left")
        .withColumn("merchant_latitude", F.when(applies, F.col("_dim_lat")))
        .withColumn("merchant_longitude", F.when(applies, F.col("_dim_lon")))
        .drop("_dim_lat", "_dim_lon")
    )


def effective_location(txns: DataFrame, merchants: DataFrame) -> DataFrame:
    """Own coordinates, else the merchant's, each coordinate on its own."""
    return (
        merchant_fallback(txns, merchants)
        .withColumn("effective_latitude", F.coalesce("latitude", "merchant_latitude"))
        .withColumn("effective_longitude", F.coalesce("longitude", "merchant_longitude"))
        .drop("merchant_latitude", "merchant_longitude")
    )


def with_event_time(txns: DataFrame) -> DataFrame:
    return txns.withColumn("us", F.unix_micros("timestamp"))


# --- running totals per customer and currency ------------------------------------------------

def moments(count: Column, total: Column, squares: Column, rough_squares: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation from count, sum and sum of squared units.

    n·Σx² − (Σx)² is evaluated on whole numbers, so equal amounts give exactly zero. Where that does not fit the
    widest decimal, or the sum of squares itself does not, doubles take over: ``rough_squares`` is the same sum as a
    double and is never NULL, and what is within its rounding error counts as zero.
    """
    some = F.when(count > 0, count)  # NULL for an empty history, so nothing divides by zero
    n = some.cast("decimal(12,0)")
    units = (total * F.lit(10_000)).cast("decimal(33,0)")
    exact = F.try_subtract(F.try_multiply(squares, n), F.try_multiply(units, units)).cast("double")
    mean_units = units.cast("double") / some
    mean_square = rough_squares / some
    difference = mean_square - mean_units * mean_units
    rough = F.when(difference > 1e-12 * mean_square, difference).otherwise(0.0)
    variance = F.greatest(F.coalesce(exact / (some.cast("double") * some), rough), F.lit(0.0))
    deviation = F.sqrt(variance) / 10_000.0
    return (F.coalesce(mean_units / 10_000.0, F.lit(0.0)),
            F.when(deviation < 1e-9, 0.0).otherwise(deviation))


WEIGHTS = ("raw", "hour_w", "day_w", "base_n", "base_s", "base_q", "base_r")


def weighted(rows: DataFrame, since_us: int | None = None) -> DataFrame:
    """Adds what each row counts for in the sums of later ones: an hour's spend, a day's spend, the baseline. Rows before
    ``since_us`` count for the hour alone, because stored tables already hold them for the rest."""
    units = amount_units(F.col("amount"))
    inside = F.lit(True) if since_us is None else F.col("us") >= F.lit(since_us)
    amount = F.col("amount").cast("decimal(29,4)")
    counted = {"day_w": amount, "base_n": F.lit(1).cast("long"), "base_s": amount, "base_q": F.try_multiply(units, units),
               "base_r": units.cast("double") * units.cast("double")}
    return rows.withColumns({"raw": F.lit(True), "hour_w": amount, **{name: F.when(inside, value) for name, value in counted.items()}})


def with_spend_and_baseline(rows: DataFrame, cfg: RuleConfig, mode: str = EXACT) -> DataFrame:
    """Adds hourly and daily spend and the amount baseline over earlier rows of the same currency.

    ``exact`` looks back 24 hours and ``baseline_days`` days to the microsecond,
    both edges included. ``bucketed`` looks back 24 clock hours and
    ``baseline_days`` calendar days including the running one.

    Rows with ``WEIGHTS`` count for these; those that are not ``raw`` add to the sums and are gone afterwards.
    """
    per_currency = Window.partitionBy("customer_id", "currency")
    earlier = per_currency.orderBy("us", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)

    def until(order, offset):
        return per_currency.orderBy(order).rangeBetween(Window.unboundedPreceding, -offset)

    before_hour = until("us", cfg.hourly_minutes * MINUTE)
    if mode == EXACT:
        before_day, before_span = until("us", DAY + 1), until("us", cfg.baseline_days * DAY + 1)
    elif mode == BUCKETED:
        before_day, before_span = until("hour", 24), until("day", cfg.baseline_days)
        rows = rows.withColumns({"hour": epoch_hour(F.col("us")), "day": epoch_day(F.col("us"))})
    else:
        raise ValueError(f"mode must be '{EXACT}' or '{BUCKETED}', not {mode!r}")
    weights = "raw" in rows.columns
    if weights:
        n, total, square, rough, by_hour, by_day = (F.col(c) for c in ("base_n", "base_s", "base_q", "base_r", "hour_w", "day_w"))
    else:
        units = amount_units(F.col("amount"))
        n, total = F.lit(1), F.col("amount")
        square, rough = F.try_multiply(units, units), units.cast("double") * units.cast("double")
        by_hour = by_day = total
    running = {"_n": F.sum(n), "_s": F.sum(total), "_q": F.try_sum(square), "_r": F.sum(rough)}
    spend = {"hour": "_s", "day": "_s"}
    if weights:
        running |= {"_h": F.sum(by_hour), "_d": F.sum(by_day)}
        spend = {"hour": "_h", "day": "_d"}
    # Windows of one call share a pass wherever they share an order.
    totals = rows.withColumns({name: value.over(earlier) for name, value in running.items()}).withColumns({
        "_hour": F.sum(by_hour).over(before_hour), "_day": F.sum(by_day).over(before_day),
        "_n0": F.sum(n).over(before_span), "_s0": F.sum(total).over(before_span),
        "_q0": F.try_sum(square).over(before_span), "_r0": F.sum(rough).over(before_span),
    })
    if weights:
        totals = totals.where("raw")

    def known(name):
        return F.coalesce(F.col(name), F.lit(0).cast("decimal(29,4)"))

    def known_count(name):
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    def known_squares(name, count):
        # NULL with rows behind it means the sum did not fit; moments then uses the doubles.
        return F.when(known_count(count) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.col(name))

    count = known_count("_n") - known_count("_n0")
    mean, deviation = moments(count, known("_s") - known("_s0"),
                              F.try_subtract(known_squares("_q", "_n"), known_squares("_q0", "_n0")),
                              F.coalesce("_r", F.lit(0.0)) - F.coalesce("_r0", F.lit(0.0)))
    return totals.select(*[c for c in rows.columns if c not in ("hour", "day", *WEIGHTS)], *[
        (known(spend[span]) - known(f"_{span}")).cast("decimal(29,4)").alias(alias)
        for span, alias in (("hour", "hourly_spend"), ("day", "daily_spend"))
    ], count.alias("baseline_count"), mean.alias("baseline_mean"), deviation.alias("baseline_stddev"))


# --- short-window features ------------------------------------------------------------------

# What later steps need to know of an earlier transaction.
RECENT_ENTRY = """named_struct(
    'us', us, 'transaction_id', transaction_id, 'merchant_id', merchant_id, 'amount', amount,
    'currency', currency, 'latitude', latitude, 'longitude', longitude,
    'device', CASE WHEN device_fingerprint RLIKE '\\\\S' THEN device_fingerprint END)"""


def with_counts_and_recent(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Adds the activity counts and ``recent``, the list of the customer's latest transactions.

    Only for customers known to be small; see :func:`build_context`.
    """
    per_customer = Window.partitionBy("customer_id")
    earlier = per_customer.orderBy("us", "transaction_id").rowsBetween(Window.unboundedPreceding, -1)

    def until(minutes):
        return per_customer.orderBy("us").rangeBetween(Window.unboundedPreceding, -minutes * MINUTE)

    reach = max(cfg.cloning_minutes * 60, cfg.device_minutes * 60, cfg.geographic_minutes * 60,
                cfg.duplicate_physical_seconds, cfg.duplicate_remote_seconds)
    latest = per_customer.orderBy("us").rangeBetween(-(reach * SECOND - 1), 0)
    everything, physical = F.count(F.lit(1)), F.count(F.when(is_physical(F.col("transaction_type")), 1))
    counted = rows.withColumns({
        "_n": everything.over(earlier), "_p": physical.over(earlier),
    }).withColumns({
        "_lookback": everything.over(until(cfg.lookback_minutes)),
        "_velocity": everything.over(until(cfg.velocity_minutes)),
        "_cross": everything.over(until(cfg.cross_merchant_minutes)),
        "_channel": everything.over(until(cfg.multi_channel_minutes)),
        "_channel_p": physical.over(until(cfg.multi_channel_minutes)),
        "recent": F.collect_list(F.expr(RECENT_ENTRY)).over(latest),
    })
    return counted.selectExpr(
        *rows.columns, "recent",
        "_n - _lookback AS recent_count", "_n - _velocity AS velocity_count", "_n - _cross AS cross_merchant_count",
        "_p - _channel_p AS physical_count", "(_n - _channel) - (_p - _channel_p) AS remote_count")


def counts_from_recent(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """The counts of :func:`with_counts_and_recent`, for rows that carry a full ``recent`` list.

    Its entries additionally hold ``physical``. Used by the stream, whose state is that list.
    """
    def count(minutes, more="true"):
        return f"cast(size(filter(recent, x -> x.us > us - {minutes * MINUTE} AND {more})) as bigint)"

    return rows.selectExpr(
        "*", f"{count(cfg.lookback_minutes)} AS recent_count", f"{count(cfg.velocity_minutes)} AS velocity_count",
        f"{count(cfg.cross_merchant_minutes)} AS cross_merchant_count",
        f"{count(cfg.multi_channel_minutes, 'x.physical')} AS physical_count",
        f"{count(cfg.multi_channel_minutes, 'NOT x.physical')} AS remote_count",
        "aggregate(filter(recent, x -> x.currency = currency AND "
        f"x.us > us - {cfg.hourly_minutes * MINUTE}), cast(0 as decimal(29,4)), "
        "(total, x) -> cast(total + x.amount as decimal(29,4))) AS hourly_spend")


def features_from_recent(rows: DataFrame, cfg: RuleConfig, ordered_before: bool = True) -> DataFrame:
    """Reduces ``recent`` to the features that compare single transactions. Used by batch and stream.

    ``ordered_before`` keeps only entries before the row in (time, id) order; the
    stream hands over arrivals in its own order and turns it off.
    """
    before = "x.us < us OR (x.us = us AND x.transaction_id < transaction_id)" if ordered_before else "true"
    near = max(cfg.cloning_minutes * 60, cfg.duplicate_physical_seconds, cfg.duplicate_remote_seconds) * SECOND
    same = "x.amount = amount AND x.currency = currency"
    duplicate_span = (f"CASE WHEN transaction_type <=> '{CARD_NOT_PRESENT}' THEN {cfg.duplicate_remote_seconds * SECOND}"
                      f" ELSE {cfg.duplicate_physical_seconds * SECOND} END")
    travel = too_fast_sql("effective_latitude", "effective_longitude", "x.latitude", "x.longitude", "abs(us - x.us)",
                          cfg.geographic_max_kmh)
    kept = [c for c in rows.columns if c != "recent"]
    return rows.selectExpr(*kept, f"filter(recent, x -> {before}) AS recent").selectExpr(
        *kept,
        f"filter(recent, x -> x.us > us - {near} AND {same}) AS _same",
        f"""array_distinct(transform(filter(recent,
            x -> x.device IS NOT NULL AND x.us > us - {cfg.device_minutes * MINUTE}), x -> x.device)) AS _devices""",
        f"""CASE WHEN effective_latitude IS NOT NULL AND effective_longitude IS NOT NULL THEN
            array_max(transform(filter(recent,
                x -> abs(us - x.us) >= {MINUTE} AND x.us > us - {cfg.geographic_minutes * MINUTE}
                     AND x.latitude IS NOT NULL AND x.longitude IS NOT NULL AND {travel}),
                x -> struct(x.us, x.transaction_id, x.latitude, x.longitude))) END AS _conflict""",
    ).selectExpr(
        *kept,
        f"exists(_same, x -> x.merchant_id = merchant_id AND x.us > us - {duplicate_span}) AS duplicate_seen",
        f"""cast(size(array_distinct(transform(filter(_same,
            x -> x.merchant_id <> merchant_id AND x.us > us - {cfg.cloning_minutes * MINUTE}),
            x -> x.merchant_id))) as bigint) AS cloned_merchants""",
        "cast(size(_devices) as bigint) AS known_devices",
        "coalesce(array_contains(_devices, device_fingerprint), false) AS device_known",
        "_conflict.latitude AS conflict_latitude", "_conflict.longitude AS conflict_longitude")


def recent_transactions(rows: DataFrame, transaction_id: str, cfg: RuleConfig) -> DataFrame:
    """Rows of the same customer inside the lookback before one transaction, newest first.

    The single transaction found by id is the only thing broadcast.
    """
    this = rows.where(F.col("transaction_id") == transaction_id).limit(1).select(
        "customer_id", F.col("us").alias("_now"), F.col("transaction_id").alias("_id"))
    return (
        rows.join(F.broadcast(this), "customer_id")
        .where((F.col("us") > F.col("_now") - cfg.lookback_minutes * MINUTE)
               & ((F.col("us") < F.col("_now"))
                  | ((F.col("us") == F.col("_now")) & (F.col("transaction_id") < F.col("_id")))))
        .drop("_now", "_id").orderBy(F.col("us").desc(), F.col("transaction_id").desc())
    )


# --- the whole context ------------------------------------------------------------------------

def build_context(txns: DataFrame, merchants: DataFrame, cfg: RuleConfig | None = None,
                  mode: str = EXACT, skew: SkewConfig | None = None, keep: tuple[str, ...] = (),
                  carried: DataFrame | None = None, since_us: int | None = None) -> DataFrame:
    """Transactions with effective location, event time and every name in ``FEATURES``; columns in ``keep`` go along.

    ``transaction_id`` must be unique; see :func:`swipewatch.sources.ingest.dedupe`.
    One job first lists the hot customers, if any, in a table, so that the usual plan carries nothing for them.
    Both ways give the same rows.

    ``carried`` stands for transactions before ``since_us`` that are not read: rows ``(customer_id, currency, us)`` with
    some of ``WEIGHTS``, see :func:`swipewatch.operators.buckets.carried_rows`.
    """
    cfg, skew = cfg or RuleConfig(), skew or SkewConfig()
    slim = with_event_time(txns.select(*TRANSACTION_FIELDS, *keep))
    hot, count, hot_count = hot_customers.find_hot(slim, skew)
    rows = effective_location(slim, merchants)
    if carried is not None:
        rows = weighted(rows, since_us).unionByName(carried.withColumn("raw", F.lit(False)), allowMissingColumns=True)
        more = carried.count()
        count, hot_count = count + more, hot_count + more
    if hot is None:
        return ordinary_context(rows, cfg, mode, count)
    # no broadcast hint: the list has no bound, so its size decides
    usual = ordinary_context(rows.join(hot.select("customer_id"), "customer_id", "left_anti"), cfg, mode, count)
    rows = rows if carried is not None else weighted(rows)
    busy = hot_customers.hot_context(rows.join(hot, "customer_id"), cfg, mode == BUCKETED, hot_count)
    return usual.unionByName(busy)


def ordinary_context(rows: DataFrame, cfg: RuleConfig, mode: str, count: int) -> DataFrame:
    # One exchange serves the per-currency and the per-customer windows. The list
    # comes last, so it is never sorted or shuffled.
    placed = with_spend_and_baseline(tables.dealt(rows, count, "customer_id"), cfg, mode)
    return features_from_recent(with_counts_and_recent(placed, cfg), cfg)
