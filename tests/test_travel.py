"""The walk back through boxes against all pairs, and its cost on very dense hours."""

import time

import numpy as np
import pytest

from swipewatch.operators import travel
from swipewatch.operators.travel import kilometres, newest_conflicts

HOUR, MINUTE = 3_600_000_000, 60_000_000


def brute(now, lat, lon, seen, seen_lat, seen_lon, window, max_kmh):
    out = []
    for t, a, o in zip(now, lat, lon):
        gap = t - seen
        far = kilometres(a, o, seen_lat, seen_lon)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = (gap >= MINUTE) & (gap < window) & (far / ((gap // 1000) / 3_600_000) > max_kmh)
        out.append(int(np.flatnonzero(hit)[-1]) if hit.any() else -1)
    return out


def places(kind, n, rng):
    if kind == "world":
        return np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    if kind == "city":
        return 52 + rng.normal(0, 0.02, n), 21 + rng.normal(0, 0.03, n)
    if kind == "towns":  # a few kilometres to either side of what can be travelled in a minute or two
        return 52 + 0.1 * rng.integers(0, 4, n) + rng.normal(0, 0.01, n), 21 + rng.normal(0, 0.02, n)
    if kind == "date line":
        return rng.normal(0, 0.1, n), 180 - np.abs(rng.normal(0, 0.1, n)) * np.where(rng.random(n) < 0.5, 1, -1) % 360 - 360 * (rng.random(n) < 0.5)
    lat, lon = places("city", n, rng)  # "outliers"
    far = rng.random(n) < 0.002
    return np.where(far, -33.9, lat), np.where(far, 18.4, lon)


@pytest.mark.parametrize("kind", ["world", "city", "towns", "date line", "outliers"])
@pytest.mark.parametrize("n, span", [(3000, HOUR), (9000, HOUR // 8), (500, 30 * HOUR), (1, HOUR)])
def test_same_as_all_pairs(kind, n, span):
    rng = np.random.default_rng(n)
    seen = np.sort(rng.integers(0, span // 1000, n) * 1000)
    seen[: n // 3] -= seen[: n // 3] % MINUTE  # equal times and whole minutes between
    lat, lon = places(kind, n, rng)
    chosen = rng.choice(n, min(n, 400), replace=False)
    args = (seen[chosen], lat[chosen], lon[chosen], seen, lat, lon, HOUR, 900.0)
    assert newest_conflicts(*args).tolist() == brute(*args)


def test_nothing_seen():
    none = np.zeros(0)
    assert newest_conflicts(np.array([5]), np.array([1.0]), np.array([1.0]), none.astype(int), none, none, HOUR, 900.0).tolist() == [-1]


@pytest.mark.parametrize("kind", ["world", "city", "outliers"])
def test_a_hundred_thousand_places_in_one_hour(kind):
    """All coordinates differ; 100,000 transactions would be five thousand million pairs."""
    rng = np.random.default_rng(1)
    taken = []
    for n in (12_500, 100_000):
        seen = np.sort(rng.integers(0, HOUR, n))
        lat, lon = places(kind, n, rng)
        start = time.process_time()
        found = newest_conflicts(seen, lat, lon, seen, lat, lon, HOUR, 900.0)
        taken.append(time.process_time() - start)
    assert len(found) == 100_000 and taken[1] < 60
    assert taken[1] < 30 * max(taken[0], 0.1)  # eight times the rows; all pairs would be 64 times the work


@pytest.mark.parametrize("held", [1, 7, 1 << 16])
def test_slabs_walk_together(spark, monkeypatch, held):
    """Many small slabs and one large one, however many rows are gathered, against all pairs of each customer."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(travel, "HELD", held)
    rows, wanted = [], {}
    for customer, (n, span) in enumerate([(300, HOUR // 2), (40, 90 * HOUR), (1, HOUR), (60, 2 * HOUR)]):
        us = np.sort(rng.integers(0, span // 1000, n) * 1000) + 5 * HOUR
        lat, lon = places("towns", n, rng)
        for i, hit in enumerate(brute(us, lat, lon, us, lat, lon, HOUR, 900.0)):
            rows.append((f"C-{customer}", int(us[i]), f"{customer}-{i:04d}", float(lat[i]), float(lon[i])))
            if hit >= 0:
                wanted[f"{customer}-{i:04d}"] = (float(lat[hit]), float(lon[hit]))
    frame = spark.createDataFrame(rows, "customer_id string, us long, transaction_id string, latitude double, longitude double")
    frame = frame.selectExpr("*", "latitude AS effective_latitude", "longitude AS effective_longitude")
    found = {r[0]: (r[1], r[2]) for r in travel.travel_conflicts(frame, 60, 900.0, len(rows)).collect()}
    assert found == wanted and len(wanted) > 20
