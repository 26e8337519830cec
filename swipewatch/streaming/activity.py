"""Per-customer state of the stream: latest transactions, hourly spend, daily amount statistics.

The state operator only keeps and hands out history. Features, rules and score
are the same Column expressions the batch uses, applied to its output.

A transaction adds one entry and changes two buckets, and every entry and bucket leaves the state once: what is written
does not depend on how much the state holds. Sums over buckets are kept as totals while the rows of a micro-batch pass
and change by what comes in and what falls out, so a row costs the same however many rows its customer has.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from swipewatch.config import DAY, HOUR, MINUTE, RuleConfig
from swipewatch.schemas import AMOUNT, PHYSICAL_TYPES, TRANSACTION

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
KEPT_HOURS = 24  # fixed value
_LAST = chr(0x10FFFF)  # sorts behind every id
SPEND = T.DecimalType(29, 4)
SQUARES = T.DecimalType(38, 0)


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


ENTRY = _struct(
    ("us", T.LongType()), ("transaction_id", T.StringType()), ("merchant_id", T.StringType()), ("amount", AMOUNT),
    ("currency", T.StringType()), ("physical", T.BooleanType()), ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()), ("device", T.StringType()))
HOUR_KEY = _struct(("hour", T.LongType()), ("currency", T.StringType()))
HOUR_VALUE = _struct(("spend", SPEND))
DAY_KEY = _struct(("day", T.LongType()), ("currency", T.StringType()))
DAY_VALUE = _struct(("n", T.LongType()), ("total", SPEND), ("squares", T.StringType()))
ENTRY_KEY = _struct(("us", T.LongType()), ("transaction_id", T.StringType()))

HISTORY = _struct(
    *[(f.name, f.dataType) for f in TRANSACTION.fields],
    ("us", T.LongType()),
    ("recent", T.ArrayType(ENTRY)), ("daily_spend", SPEND), ("baseline_count", T.LongType()),
    ("baseline_total", SPEND), ("baseline_squares", SQUARES), ("baseline_rough", T.DoubleType()))


class Totals:
    """Buckets by (time, currency), and per currency the sum of those of the last ``width`` times.

    Values are tuples of numbers that add up. Times asked for may go back as well as forward: a total moves to the time
    asked for by the buckets in between alone."""

    def __init__(self, buckets: dict, width: int, zero: tuple):
        self.buckets, self.width, self.zero = buckets, width, zero
        self.changed: set = set()
        self.standing: dict = {}  # currency -> [time, total]
        self.times: dict = {}
        self.expired = -2 ** 63
        for time, currency in buckets:
            self.times.setdefault(currency, set()).add(time)

    def as_of(self, time: int, currency: str) -> tuple:
        """The sum of all buckets after ``time - width``, later ones than ``time`` too."""
        edge = time - self.width
        at, total = self.standing.get(currency, (None, self.zero))
        times = self.times.get(currency, set())
        if at is None:
            crossed, sign = [t for t in times if t > edge], 1
        elif at < edge:
            crossed, sign = [t for t in times if at < t <= edge], -1
        else:
            crossed, sign = ([t for t in times if edge < t <= at], 1) if at > edge else ([], 1)
        for t in crossed:
            total = tuple(x + sign * y for x, y in zip(total, self.buckets[t, currency]))
        self.standing[currency] = edge, total
        return total

    def add(self, time: int, currency: str, value: tuple) -> None:
        key = time, currency
        self.buckets[key] = tuple(x + y for x, y in zip(self.buckets.get(key, self.zero), value))
        self.times.setdefault(currency, set()).add(time)
        self.changed.add(key)
        if currency in self.standing:
            at, total = self.standing[currency]
            if time > at:
                self.standing[currency] = at, tuple(x + y for x, y in zip(total, value))

    def expire(self, time: int) -> None:
        """Buckets that are too old at ``time`` go. Looked for once per time; a bucket added later for a time long past
        stays until the next one, outside of every sum."""
        if time <= self.expired:
            return
        self.expired = time
        for key in [key for key in self.buckets if key[0] <= time - self.width]:
            value = self.buckets.pop(key)
            self.times[key[1]].discard(key[0])
            at, total = self.standing.get(key[1], (key[0], ()))
            if key[0] > at:
                self.standing[key[1]] = at, tuple(x - y for x, y in zip(total, value))


class CustomerActivity(StatefulProcessor):
    """Emits each new transaction with the history before it, then adds it to the state.

    Rows of one micro-batch are taken in (time, id) order. Ids come in once; see :mod:`swipewatch.streaming.run`. Late rows
    are judged against the state as it is; nothing is dropped for lateness. State that is not written again expires
    after twice the baseline's days of running time.
    """

    def __init__(self, cfg: RuleConfig):
        self.lookback = cfg.lookback_minutes * MINUTE
        self.days = cfg.baseline_days
        self.keep_ms = 2 * cfg.baseline_days * DAY // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent_state = handle.getMapState("recent", ENTRY_KEY, ENTRY, ttlDurationMs=self.keep_ms)
        self.hour_state = handle.getMapState("hours", HOUR_KEY, HOUR_VALUE, ttlDurationMs=self.keep_ms)
        self.day_state = handle.getMapState("days", DAY_KEY, DAY_VALUE, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # in order of arrival at this operator within (time, id), as far as the state goes back
        recent = sorted(tuple(value) for _, value in self.recent_state.iterator())
        stored, gone = {entry[:2] for entry in recent}, set()
        hours = Totals({tuple(k): (v[0],) for k, v in self.hour_state.iterator()}, KEPT_HOURS, (Decimal(0),))
        days = Totals({tuple(k): (v[0], v[1], int(v[2])) for k, v in self.day_state.iterator()}, self.days, (0, Decimal(0), 0))
        old_hours, old_days = set(hours.buckets), set(days.buckets)
        for us, row in sorted(((_micros(row["timestamp"]), row) for row in rows),
                              key=lambda pair: (pair[0], pair[1]["transaction_id"])):
            yield self._with_history(row, us, recent, hours, days)
            start = bisect_right(recent, (us - self.lookback, _LAST))
            gone.update(entry[:2] for entry in recent[:start])
            del recent[:start]
            insort(recent, _entry(row, us), key=lambda entry: entry[:2])
            hours.expire(us // HOUR)
            days.expire(us // DAY)
            units = int(row["amount"].scaleb(4))
            hours.add(us // HOUR, row["currency"], (row["amount"],))
            days.add(us // DAY, row["currency"], (1, row["amount"], units * units))
        for entry in gone & stored:
            self.recent_state.removeKey(entry)
        for entry in recent:
            if entry[:2] not in stored:
                self.recent_state.updateValue(entry[:2], entry)
        _save(self.hour_state, old_hours, hours, lambda v: v)
        _save(self.day_state, old_days, days, lambda v: (v[0], v[1], str(v[2])))

    def _with_history(self, row, us, recent, hours, days) -> Row:
        # Read again as of this transaction; what the state was pruned to last does not matter.
        (spend,) = hours.as_of(us // HOUR, row["currency"])
        n, total, squares = days.as_of(us // DAY, row["currency"])
        names = ENTRY.fieldNames()
        start = bisect_right(recent, (us - self.lookback, _LAST))
        return Row(
            **{name: row[name] for name in TRANSACTION.fieldNames()}, us=us,
            recent=[dict(zip(names, entry)) for entry in recent[start:]],
            daily_spend=spend, baseline_count=n, baseline_total=total,
            # whole numbers of any size: a decimal context would round them. Beyond the declared type the sum is
            # unknown, and the deviation then comes from doubles.
            baseline_squares=_fits(squares), baseline_rough=float(squares))

    def close(self) -> None:
        pass


def _fits(squares: int) -> Decimal | None:
    return Decimal(squares) if squares < 10 ** 38 else None


def _micros(moment: datetime) -> int:
    delta = moment.astimezone(timezone.utc) - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _entry(row, us: int) -> tuple:
    device = row["device_fingerprint"]
    return (us, row["transaction_id"], row["merchant_id"], row["amount"], row["currency"],
            row["transaction_type"] in PHYSICAL_TYPES, row["latitude"], row["longitude"],
            device if device and device.strip() else None)


def _save(state, before: set, totals: Totals, pack) -> None:
    for gone in before - totals.buckets.keys():
        state.removeKey(gone)
    for key in totals.changed & totals.buckets.keys():
        state.updateValue(key, pack(totals.buckets[key]))
