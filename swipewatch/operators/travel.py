"""Places a customer cannot have come from in time, for customers with very many transactions.

A transaction conflicts with an earlier place if getting from there in the time between would take more than a given
speed. Only places inside its speed cone can be without conflict, so two kinds of neighbourhoods need no pairs: what
lies so near in space, for its age, that nobody needs to be fast, and what lies behind the newest conflict.

Visits are in order of time and cut into blocks, and blocks into larger ones; each keeps the box around its places (as points
in space, so nothing special happens at poles and date lines). A transaction walks back from the newest visit it may be
compared with. A block whose farthest corner is within reach at the age of its newest visit is passed over as a whole;
else its visits are compared one by one, and the walk ends at the first conflict, which is the newest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipewatch.config import MINUTE
from swipewatch.functions.columns import EARTH_RADIUS_KM, floor_div
from swipewatch.sources import tables

SMALL, LARGE = 64, 4096  # visits of a block and of a block of blocks
AT_ONCE = 1 << 14        # transactions that walk together
HELD = 1 << 16           # rows of small slabs that are gathered before they walk
SLACK_KM = 1e-6          # boxes are rounded; a block this near to the limit is looked into


def points(latitude: np.ndarray, longitude: np.ndarray) -> np.ndarray:
    """Unit vectors."""
    lat, lon = np.radians(latitude), np.radians(longitude)
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


class Boxes:
    """The corners of the boxes around every ``size`` points in a row."""

    def __init__(self, at: np.ndarray, size: int):
        starts = np.arange(0, len(at), size)
        self.low, self.high = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)

    def farthest_km(self, box: np.ndarray, point: np.ndarray) -> np.ndarray:
        """No point of the box is farther away on the surface."""
        gap = np.maximum(np.abs(point - self.low[box]), np.abs(point - self.high[box]))
        chord = np.sqrt((gap * gap).sum(axis=-1))
        return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(chord / 2, 1.0)) + SLACK_KM


def kilometres(lat1, lon1, lat2, lon2):
    half = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
            + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(half), np.sqrt(1 - half))


def newest_conflicts(now: np.ndarray, latitude: np.ndarray, longitude: np.ndarray, seen: np.ndarray, seen_lat: np.ndarray,
                     seen_lon: np.ndarray, window: int, max_kmh: float, least: int = MINUTE) -> np.ndarray:
    """For each transaction at ``now`` and its place the index of the newest conflicting visit, or -1. Visits are sorted by
    time and count from ``least`` after them until ``window`` after them, all in microseconds."""
    out = np.full(len(now), -1)
    if not len(seen):
        return out
    at, here = points(seen_lat, seen_lon), points(latitude, longitude)
    levels = [(size, Boxes(at, size)) for size in (LARGE, SMALL)]
    first = np.searchsorted(seen, now - window, "right")
    last = np.searchsorted(seen, now - least, "right")
    reach = lambda gap: max_kmh * ((gap // 1000) / 3_600_000.0)
    steps = np.arange(SMALL)
    for begin in range(0, len(now), AT_ONCE):
        who = np.arange(begin, min(len(now), begin + AT_ONCE))
        stop = last[who]
        while True:
            more = stop > first[who]
            who, stop = who[more], stop[more]
            if not len(who):
                break
            within = reach(now[who] - seen[stop - 1])
            passed = np.zeros(len(who), bool)
            for size, boxes in levels:
                box = (stop - 1) // size
                near = ~passed & (boxes.farthest_km(box, here[who]) <= within)
                stop = np.where(near, box * size, stop)
                passed |= near
            look = np.flatnonzero(~passed)
            if not len(look):
                continue
            own, start = who[look], (stop[look] - 1) // SMALL * SMALL
            index = start[:, None] + steps
            counts = (index < stop[look][:, None]) & (index >= first[own][:, None])
            index = np.minimum(index, len(seen) - 1)
            far = kilometres(latitude[own][:, None], longitude[own][:, None], seen_lat[index], seen_lon[index])
            hours = ((now[own][:, None] - seen[index]) // 1000) / 3_600_000.0
            with np.errstate(divide="ignore", invalid="ignore"):
                conflict = counts & ~(far / hours <= max_kmh)
            found = conflict.any(axis=1)
            newest = SMALL - 1 - np.argmax(conflict[:, ::-1], axis=1)
            out[own[found]] = index[found, newest[found]]
            stop[look] = np.where(found, 0, start)  # nothing is left to walk where a conflict is found
    return out


def group_starts(group: pa.Table) -> np.ndarray:
    """Where a customer's slab begins in rows sorted by both."""
    customer = group["customer_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    slab = group["slab"].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (customer[1:] != customer[:-1]) | (slab[1:] != slab[:-1])]))


def travel_conflicts(rows: DataFrame, minutes: int, max_kmh: float, count: int) -> DataFrame:
    """``(transaction_id, conflict_latitude, conflict_longitude)`` of the transactions that have one: the newest earlier
    place of the same customer, by (time, id), that is too far away. There are about ``count`` rows.

    Time is cut into slabs of one window. A slab's transactions need its visits and those of the slab before, so every visit
    goes to two tasks at most. Slabs pass through a task in order and walk together, many small ones at once, on a common
    clock on which each is more than a window from the next; the most a task holds is two windows of one customer, or
    ``HELD`` rows."""
    window = minutes * MINUTE
    slab = floor_div(F.col("us"), window)
    where = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    asks = F.col("effective_latitude").isNotNull() & F.col("effective_longitude").isNotNull()
    own = F.when(where | asks, slab)
    dealt = (rows.select("customer_id", "us", "transaction_id", "latitude", "longitude", "effective_latitude", "effective_longitude",
                         F.explode(F.array_compact(F.array(own, F.when(where, slab + 1)))).alias("slab"))
             .withColumn("asks", asks & (F.col("slab") == slab)))
    dealt = tables.dealt(dealt, 2 * count, "customer_id", "slab").sortWithinPartitions(
        "customer_id", "slab", "us", F.asc_nulls_last("transaction_id"))
    schema = pa.schema([("transaction_id", pa.string()), ("conflict_latitude", pa.float64()), ("conflict_longitude", pa.float64())])

    def walk(group: pa.Table) -> pa.RecordBatch:
        starts = group_starts(group)
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(group))))
        # visits of a slab lie from 0 to 2 windows behind the start of the one before
        clock = group["us"].to_numpy() + (4 * number - (group["slab"].to_numpy() - 1)) * window
        group = group.append_column("clock", pa.array(clock))
        column = lambda table, name: table[name].to_numpy()
        visits = group.filter(pc.and_(pc.is_valid(group["latitude"]), pc.is_valid(group["longitude"])))
        probes = group.filter(group["asks"])
        found = newest_conflicts(
            column(probes, "clock"), column(probes, "effective_latitude"), column(probes, "effective_longitude"), column(visits, "clock"),
            column(visits, "latitude"), column(visits, "longitude"), window, max_kmh)
        some = found >= 0
        place = pa.array(found[some])
        table = pa.Table.from_arrays([probes["transaction_id"].filter(pa.array(some)), visits["latitude"].take(place),
                                      visits["longitude"].take(place)], schema=schema)
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], schema=schema)

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, HELD
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= due:
                group = pa.Table.from_batches(held)
                cut = int(group_starts(group)[-1])
                if cut:
                    yield walk(group.slice(0, cut))
                held, n = group.slice(cut).to_batches(), n - cut
                due = max(HELD, 2 * n)  # a slab of any size is looked through a few times only
        if n:
            yield walk(pa.Table.from_batches(held))

    return dealt.mapInArrow(walk_all, "transaction_id string, conflict_latitude double, conflict_longitude double")
