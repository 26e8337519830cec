"""Context features for customers too large for a single task.

A customer's timeline is cut into stretches, by rows and not by time, so a
customer with nearly all rows in one hour is split where the rows are. What a
stretch has to know of the others is carried in as rows of its own, so events
are dealt out once, by stretch, and never joined:

* the nearest row before and after with the same merchant, amount and currency,
  or from the same device, which tells duplicates, and where a value begins and
  ceases to be among those of a window;
* the sums of the stretches before.

Every transaction becomes an arrival and, per window length, one departure at
the moment it leaves that window. A running total of arrivals minus departures
is then the content of the sliding window. No task ever needs the whole customer
and no pair of transactions is formed for counts and sums.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from swipewatch.config import DAY, HOUR, MINUTE, SECOND, RuleConfig, SkewConfig
from swipewatch.functions.columns import amount_units, blank, epoch_day, epoch_hour, is_physical
from swipewatch.operators.travel import travel_conflicts
from swipewatch.schemas import CARD_NOT_PRESENT
from swipewatch.sources import tables

HOT = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("hot_last", T.LongType()),
    T.StructField("splitters", T.ArrayType(T.LongType())),
])
ARRIVAL, DAY_OUT, SPAN_OUT, CARRIED = 0, -1, -2, -3  # ticks; any positive tick is a departure after that many µs
EVENTS_PER_ROW = 8
HOT_FIELDS = ("hot_last", "splitters")
MARKS = ("block", "device", "same_before", "new_merchant", "last_merchant", "own_before", "new_device", "last_device")
STRETCHES = 256  # of one customer's timeline at most; beyond, stretches grow with the customer
WEIGHTS = ("raw", "hour_w", "day_w", "base_n", "base_s", "base_q", "base_r")


class Found(NamedTuple):
    """The hot customers, if any, and how many rows there are, of all and of hot customers."""

    customers: DataFrame | None
    rows: int
    hot_rows: int


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table of the shared folder."""
    spark = frame.sparkSession
    path = tables.join_path(tables.shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def find_hot(rows: DataFrame, skew: SkewConfig) -> Found:
    """All customers that are hot. A customer is hot with ``hot_rows`` rows altogether or ``dense_rows`` rows
    in one hour.

    The counts combine before their shuffles and read two columns. Mostly the largest of them show that nobody is hot;
    else the list becomes a table in the shared folder, of any length, and Spark joins it as its size demands.
    """
    blocks = F.least(F.ceil(F.col("n") * EVENTS_PER_ROW / skew.block_rows), F.lit(STRETCHES))
    counted = (
        rows.groupBy("customer_id", epoch_hour(F.col("us")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last"))
        .groupBy("customer_id").agg(F.sum("n").alias("n"), F.max("n").alias("peak"), F.max("last").alias("last"))
    )
    is_hot = (F.col("n") >= skew.hot_rows) | (F.col("peak") >= skew.dense_rows)
    most = counted.agg(F.sum("n").alias("rows"), F.sum(F.when(is_hot, F.col("n"))).alias("hot_rows")).first()
    if not most.hot_rows:
        return Found(None, most.rows or 0, 0)
    found = counted.where(is_hot).select(
        "customer_id", F.col("last").alias("hot_last"), blocks.alias("blocks"))
    # quantiles of the customer's times; every so many of them are the borders of its stretches
    shares = F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)])
    listed = (
        rows.select("customer_id", "us").join(found, "customer_id").groupBy("customer_id")
        .agg(F.max("hot_last").alias("hot_last"), F.max("blocks").alias("blocks"), F.percentile_approx("us", shares, F.lit(4 * STRETCHES)).alias("q"))
        .select("customer_id", "hot_last", F.expr(
            f"array_distinct(transform(sequence(1L, greatest(blocks, 2L) - 1), i -> q[cast(i * {STRETCHES} div greatest(blocks, 2L) - 1 as int)]))"
        ).alias("splitters"))
    )
    spark = rows.sparkSession
    path = tables.join_path(tables.shared_folder(spark), f"hot-customers-{uuid.uuid4().hex}")
    listed.write.parquet(path)
    return Found(spark.read.schema(HOT).parquet(path), most.rows, most.hot_rows)


def by_hash(*keys) -> WindowSpec:
    """Windows by ``keys``. One number comes first, so that sorting seldom compares ids that begin alike, or decimals."""
    return Window.partitionBy(F.xxhash64(*keys), *keys)


def stretch(at: Column) -> Column:
    return F.size(F.filter("splitters", lambda border: border <= at))


def nearest(rows: DataFrame, keys: list[str], name: str, span: int) -> DataFrame:
    """For every stretch the last moment before and the first one after it with the same keys, if less than ``span`` away."""
    order = by_hash(*keys).orderBy("block")
    edges = rows.groupBy(*keys, "block").agg(F.min("us").alias("first"), F.max("us").alias("last")).select(
        "*", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    near = F.array_compact(F.array(F.when(F.col("first") - F.col("before") < span, F.col("before")),
                                   F.when(F.col("after") - F.col("last") < span, F.col("after"))))
    return edges.select(*keys, "block", F.explode(near).alias("us"), F.lit(name).alias("_for"))


def marked(rows: DataFrame, cfg: RuleConfig, count: int) -> DataFrame:
    """Adds ``MARKS``: when the row's merchant, amount and currency and when its device were last seen, and whether it is
    the first or the last row with them inside the windows that count merchants and devices."""
    cloning, device_span = cfg.cloning_minutes * MINUTE, cfg.device_minutes * MINUTE
    duplicate = max(cfg.duplicate_physical_seconds, cfg.duplicate_remote_seconds) * SECOND
    us = F.col("us")
    rows = stored(rows.where(us.isNotNull()).withColumns({
        "block": stretch(us), "device": F.when(~blank(F.col("device_fingerprint")), F.col("device_fingerprint"))}), "hot-rows")
    # rows that only carry sums are nobody's neighbours
    same, own = ["customer_id", "raw", "merchant_id", "amount", "currency"], ["customer_id", "raw", "device"]
    real = rows.where("raw")
    all_rows = (rows.withColumn("_for", F.lit(None).cast("string"))
                .unionByName(nearest(real, same, "same", max(cloning, duplicate)), allowMissingColumns=True)
                .unionByName(nearest(real.where("device IS NOT NULL"), own, "own", device_span), allowMissingColumns=True))

    def beside(keys, name):
        window = by_hash(*keys, "block", F.coalesce("_for", F.lit(name))).orderBy("us", "transaction_id")
        return F.lag("us").over(window), F.lead("us").over(window)

    def first(before, span):
        return F.coalesce(before <= us - span, F.lit(True))

    def last(after, span):
        return F.coalesce(after >= us + span, F.lit(True))

    placed = tables.dealt(all_rows, count, "customer_id", "block")
    same_before, same_after = beside(same, "same")
    placed = placed.withColumns({"same_before": same_before, "_same_after": same_after})
    own_before, own_after = beside(own, "own")
    placed = placed.withColumns({"own_before": own_before, "_own_after": own_after}).where("_for IS NULL")
    has_device = F.col("raw") & F.col("device").isNotNull()
    return stored(placed.withColumns({
        "new_merchant": F.col("raw") & first(F.col("same_before"), cloning),
        "last_merchant": F.col("raw") & last(F.col("_same_after"), cloning),
        "new_device": has_device & first(F.col("own_before"), device_span),
        "last_device": has_device & last(F.col("_own_after"), device_span),
    }).drop("_for", "_same_after", "_own_after"), "hot-marked")


def timeline(rows: DataFrame, cfg: RuleConfig, bucketed: bool) -> DataFrame:
    """Arrivals and departures. Departures after the customer's last arrival change nothing and are left out."""
    us = F.col("us")
    spans = sorted({
        cfg.lookback_minutes * MINUTE, cfg.velocity_minutes * MINUTE, cfg.cross_merchant_minutes * MINUTE,
        cfg.multi_channel_minutes * MINUTE, cfg.hourly_minutes * MINUTE, cfg.cloning_minutes * MINUTE,
        cfg.device_minutes * MINUTE,
    })
    if bucketed:
        day_out = (epoch_hour(us) + 24) * F.lit(HOUR)
        span_out = (epoch_day(us) + cfg.baseline_days) * F.lit(DAY)
    else:
        day_out = us + F.lit(DAY + 1)
        span_out = us + F.lit(cfg.baseline_days * DAY + 1)
    moments = [(ARRIVAL, us), (DAY_OUT, day_out), (SPAN_OUT, span_out)] + [(span, us + F.lit(span)) for span in spans]
    ticks = F.array_compact(F.array(*[
        F.when(at <= F.col("hot_last"), F.struct(F.lit(tick).cast("long").alias("tick"), at.alias("at"), stretch(at).alias("block")))
        for tick, at in moments]))
    payload = F.struct(*[c for c in rows.columns if c not in HOT_FIELDS + WEIGHTS + ("block",)])
    own = ["customer_id", "currency", "amount", "transaction_id", *WEIGHTS, "new_merchant", "last_merchant", "new_device", "last_device"]
    return (
        rows.select(*own, is_physical(F.col("transaction_type")).alias("physical"), payload.alias("txn"), F.explode(ticks).alias("e"))
        .select(*own, "physical", "e.tick", "e.at", "e.block",
                F.when(F.col("e.tick") == ARRIVAL, F.col("txn")).alias("txn"), (F.col("e.tick") == ARRIVAL).alias("arrives"))
    )


def running_totals(events: DataFrame, levels: list[tuple[list[str], dict[str, Column]]], count: int) -> DataFrame:
    """Adds, per name, the sum of its delta over this and all earlier events with the same keys.

    All ``keys`` begin with the customer, and what the stretches before add up to comes in as one more row per keys and
    stretch, in front of its events. So events are dealt out once for all sums; the carry windows order one row per keys
    and stretch, never the events themselves.
    """
    sums = []
    for keys, deltas in levels:
        before = by_hash(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums.append(
            events.groupBy(*keys, "block").agg(*[F.try_sum(delta).alias(name) for name, delta in deltas.items()])
            .select(*keys, "block", *[F.sum(name).over(before).alias(name) for name in deltas])
            .where(reduce(lambda a, b: a | b, [F.col(name) != 0 for name in deltas])))
    fields = {field.name: field.dataType for (_, deltas), found in zip(levels, sums) for field in found.schema if field.name in deltas}
    kind = T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])
    everything = events.withColumn("carry", F.lit(None).cast(kind))
    for (keys, deltas), found in zip(levels, sums):
        carry = F.struct(*[(F.col(name) if name in deltas else F.lit(None).cast(dtype)).alias(name) for name, dtype in fields.items()])
        everything = everything.unionByName(found.select(
            *keys, "block", carry.alias("carry"), F.lit(CARRIED).cast("long").alias("tick"), F.lit(False).alias("arrives"),
            F.lit(-2 ** 63).cast("long").alias("at")), allowMissingColumns=True)
    everything = tables.dealt(everything, count, "customer_id", "block")
    for keys, deltas in levels:
        order = (by_hash(*keys, "block").orderBy("at", "arrives", "transaction_id", "tick")
                 .rowsBetween(Window.unboundedPreceding, 0))
        everything = everything.withColumns({
            name: F.try_sum(F.when(F.col("tick") == CARRIED, F.col("carry")[name]).otherwise(delta)).over(order)
            for name, delta in deltas.items()})
    return everything.drop("carry")


def change(span: int, amount=None) -> Column:
    """+amount on arrival, −amount when leaving the window of ``span``, 0 otherwise. Without an amount rows are counted,
    but for those that only carry sums."""
    amount = F.col("raw").cast("long") if amount is None else amount
    return (F.when(F.col("tick") == ARRIVAL, amount).when(F.col("tick") == span, -amount)
            .otherwise(F.lit(0).cast("long")))


def distinct_change(span: int, first: str, last: str) -> Column:
    """Change in the number of distinct values, given which rows are the first and the last with theirs."""
    return (F.when(F.col(first) & (F.col("tick") == ARRIVAL), F.lit(1).cast("long"))
            .when(F.col(last) & (F.col("tick") == span), F.lit(-1).cast("long"))
            .otherwise(F.lit(0).cast("long")))


def hot_context(rows: DataFrame, cfg: RuleConfig, bucketed: bool, count: int) -> DataFrame:
    """The features of ``context.FEATURES`` for rows joined with the hot list, about ``count`` of them."""
    from swipewatch.operators.context import FEATURES, moments

    m = MINUTE
    cloning, device_span = cfg.cloning_minutes * m, cfg.device_minutes * m
    amount = F.col("amount").cast("decimal(29,4)")
    units = amount_units(F.col("amount"))
    square = F.try_multiply(units, units)
    rough = units.cast("double") * units.cast("double")
    on = F.col("physical")
    zero = F.lit(0).cast("long")
    originals = [c for c in rows.columns if c not in HOT_FIELDS + WEIGHTS]

    rows = marked(rows, cfg, count)
    events = running_totals(timeline(rows, cfg, bucketed), [
        (["customer_id", "amount", "currency"], {"clones": distinct_change(cloning, "new_merchant", "last_merchant")}),
        (["customer_id", "currency"], {
            "s_hour": change(cfg.hourly_minutes * m, F.col("hour_w")), "s_day": change(DAY_OUT, F.col("day_w")),
            "b_n": change(SPAN_OUT, F.col("base_n")), "b_s": change(SPAN_OUT, F.col("base_s")),
            "b_q": change(SPAN_OUT, F.col("base_q")), "b_r": change(SPAN_OUT, F.col("base_r")),
        }),
        (["customer_id"], {
            "n_recent": change(cfg.lookback_minutes * m),
            "n_velocity": change(cfg.velocity_minutes * m),
            "n_cross": change(cfg.cross_merchant_minutes * m),
            "n_physical": F.when(on, change(cfg.multi_channel_minutes * m)).otherwise(zero),
            "n_remote": F.when(~on, change(cfg.multi_channel_minutes * m)).otherwise(zero),
            "devices": distinct_change(device_span, "new_device", "last_device"),
        }),
    ], 2 * count)
    # Every total above includes the arriving transaction itself; take it out again.
    now = events.where("arrives AND raw").select(
        "txn.*", "clones", "devices", "n_recent", "n_velocity", "n_cross",
        (F.col("n_physical") - on.cast("long")).alias("physical_count"),
        (F.col("n_remote") - (~on).cast("long")).alias("remote_count"),
        (F.col("s_hour") - amount).cast("decimal(29,4)").alias("hourly_spend"),
        (F.col("s_day") - amount).cast("decimal(29,4)").alias("daily_spend"),
        (F.col("b_n") - 1).alias("baseline_count"),
        (F.col("b_s") - amount).cast("decimal(29,4)").alias("_s"),
        F.try_subtract(F.col("b_q").cast("decimal(38,0)"), square).cast("decimal(38,0)").alias("_q"),
        (F.col("b_r") - rough).alias("_r"),
    )
    mean, deviation = moments(F.col("baseline_count"), F.col("_s"), F.col("_q"), F.col("_r"))
    remote = F.col("transaction_type").eqNullSafe(CARD_NOT_PRESENT)
    us, cnp, cp = F.col("us"), cfg.duplicate_remote_seconds * SECOND, cfg.duplicate_physical_seconds * SECOND
    now = now.withColumns({
        "recent_count": F.col("n_recent") - 1,
        "velocity_count": F.col("n_velocity") - 1,
        "cross_merchant_count": F.col("n_cross") - 1,
        "duplicate_seen": F.coalesce(F.col("same_before") > us - F.when(remote, F.lit(cnp)).otherwise(F.lit(cp)), F.lit(False)),
        "cloned_merchants": F.col("clones") - 1,
        "known_devices": F.col("devices") - F.col("new_device").cast("long"),
        "device_known": F.col("device").isNotNull() & ~F.col("new_device"),
        "baseline_mean": mean, "baseline_stddev": deviation,
    })
    conflicts = travel_conflicts(rows.where("raw"), cfg.geographic_minutes, cfg.geographic_max_kmh, count)
    joined = tables.dealt(now, count, "transaction_id").join(conflicts, "transaction_id", "left")
    return joined.select(*originals, *FEATURES)
