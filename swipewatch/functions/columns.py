"""Small Column helpers shared by the operators. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swipewatch.config import DAY, HOUR
from swipewatch.schemas import PHYSICAL_TYPES

EARTH_RADIUS_KM = 6371.0


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def floor_div(value: Column, size) -> Column:
    """Whole-number division rounding down, also for times before 1970."""
    size = size if isinstance(size, Column) else F.lit(size).cast("long")
    return _div(value - F.pmod(value, size), size)


def epoch_hour(us: Column) -> Column:
    return floor_div(us, HOUR)


def epoch_day(us: Column) -> Column:
    return floor_div(us, DAY)


def utc_hour(us: Column) -> Column:
    return F.pmod(epoch_hour(us), F.lit(24)).cast("int")


def amount_units(amount: Column) -> Column:
    """The amount as a whole number of its smallest stored unit, so squares stay exact."""
    return (amount * F.lit(10_000)).cast("decimal(19,0)")


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def is_physical(transaction_type: Column) -> Column:
    return transaction_type.isNotNull() & transaction_type.isin(*PHYSICAL_TYPES)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"({2 * EARTH_RADIUS_KM}D * atan2(sqrt({a}), sqrt(1.0D - {a})))"


def too_fast_sql(lat1: str, lon1: str, lat2: str, lon2: str, gap_us: str, max_kmh: float) -> str:
    """SQL text: travel between two points in ``gap_us`` (cut to whole milliseconds) beats ``max_kmh``.

    Equal points are settled first, without any trigonometry.
    """
    hours = f"(cast((({gap_us}) div 1000) as double) / 3600000.0D)"
    return (f"(({lat1} <> {lat2} OR {lon1} <> {lon2})"
            f" AND {haversine_sql(lat1, lon1, lat2, lon2)} / {hours} > {float(max_kmh)!r}D)")


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, halves rounded up, 0.0 for an empty whole."""
    share = part.cast("double") * 100.0 / F.when(whole > 0, whole).cast("double") * 100.0
    return F.coalesce(F.floor(share + 0.5) / 100.0, F.lit(0.0))


def iso_instant(us: Column) -> Column:
    """UTC instant text with no, three or six fraction digits, independent of the session time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), epoch_day(us).cast("int")).cast("string")
    second = F.pmod(floor_div(us, 1_000_000), F.lit(86400))
    micros = F.pmod(us, F.lit(1_000_000))
    clock = F.format_string("%02d:%02d:%02d", _div(second, F.lit(3600)),
                            _div(F.pmod(second, F.lit(3600)), F.lit(60)), F.pmod(second, F.lit(60)))
    fraction = (F.when(micros == 0, F.lit(""))
                .when(F.pmod(micros, F.lit(1000)) == 0, F.format_string(".%03d", _div(micros, F.lit(1000))))
                .otherwise(F.format_string(".%06d", micros)))
    return F.concat(day, F.lit("T"), clock, fraction, F.lit("Z"))
