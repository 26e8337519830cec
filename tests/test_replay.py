"""Random histories with equal times, absent fields and mixed currencies against a plain loop."""

import math
import random
from datetime import timedelta
from decimal import Decimal

import pytest

from helpers import BUSINESS, CAPE_TOWN, JOHANNESBURG, LONDON, frame, merchants, txn
from swipewatch.config import RuleConfig, SkewConfig
from swipewatch.operators.context import BUCKETED, EXACT, FEATURES, build_context

CFG = RuleConfig(baseline_days=3)
PLACES = {"M-0": LONDON, "M-1": CAPE_TOWN}


def history(seed, rows=260):
    rng = random.Random(seed)
    found = []
    for i in range(rows):
        # Bursts on a coarse grid make equal times and exact window edges common.
        at = BUSINESS + timedelta(days=rng.choice([0, 0, 0, 1, 2, 3, 4]), seconds=30 * rng.randrange(0, 260))
        if rng.random() < 0.2:
            at += timedelta(microseconds=rng.randrange(0, 1_000_000))
        found.append(txn(
            at, rng.choice(["10", "10", "99.99", "2500", "70.5", "3100.1234"]), customer=rng.choice(["A", "A", "A", "B", "C"]),
            merchant=f"M-{rng.randrange(4)}", currency=rng.choice(["ZAR", "ZAR", "USD"]), category=rng.choice([None, "RETAIL"]),
            place=rng.choice([None, CAPE_TOWN, JOHANNESBURG, LONDON]), device=rng.choice([None, " ", "d1", "d2", "d3"]),
            kind=rng.choice(["ATM", "CARD_NOT_PRESENT", "CARD_PRESENT", None]), id=f"{rng.randrange(10 ** 9):09d}-{i}"))
    return found


def micros(at):
    return round(at.timestamp() * 1_000_000)


def distance(a, b):
    half = lambda x, y: math.sin(math.radians(y - x) / 2) ** 2
    h = half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1])
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def expected(rows, mode):
    minute, day = 60_000_000, 86_400_000_000
    names = ("id", "customer", "merchant", "amount", "currency", "category", "loc", "lat", "lon", "device", "at", "kind")
    rows = [dict(zip(names, r), us=micros(r[10])) for r in rows]
    out = {}
    for t in rows:
        before = [u for u in rows if u["customer"] == t["customer"] and (u["us"], u["id"]) < (t["us"], t["id"])]
        inside = lambda span: [u for u in before if t["us"] - u["us"] < span]
        physical = lambda u: u["kind"] in ("ATM", "CARD_PRESENT", "CONTACTLESS")
        device = lambda u: u["device"] if u["device"] and u["device"].strip() else None
        same = lambda u: u["amount"] == t["amount"] and u["currency"] == t["currency"]
        mine = [u for u in before if u["currency"] == t["currency"]]
        if mode == EXACT:
            daily = [u for u in mine if t["us"] - u["us"] <= day]
            base = [u for u in mine if t["us"] - u["us"] <= CFG.baseline_days * day]
        else:
            daily = [u for u in mine if u["us"] // 3_600_000_000 > t["us"] // 3_600_000_000 - 24]
            base = [u for u in mine if u["us"] // day > t["us"] // day - CFG.baseline_days]
        amounts = [u["amount"] for u in base]
        mean = sum(amounts, Decimal(0)) / len(amounts) if amounts else Decimal(0)
        var = sum((a - mean) ** 2 for a in amounts) / len(amounts) if amounts else Decimal(0)
        fallback = PLACES.get(t["merchant"]) if t["lat"] is None and t["kind"] != "CARD_NOT_PRESENT" else None
        here = (t["lat"], t["lon"]) if t["lat"] is not None else fallback
        known = {device(u) for u in inside(60 * minute)} - {None}
        conflicts = [u for u in inside(60 * minute) if here and u["lat"] is not None and t["us"] - u["us"] >= minute
                     and distance(here, (u["lat"], u["lon"])) / ((t["us"] - u["us"]) // 1000 / 3_600_000) > 900]
        newest = max(conflicts, key=lambda u: (u["us"], u["id"]), default=None)
        out[t["id"]] = {
            "recent_count": len(inside(60 * minute)), "velocity_count": len(inside(10 * minute)),
            "cross_merchant_count": len(inside(10 * minute)),
            "duplicate_seen": any(same(u) and u["merchant"] == t["merchant"] for u in inside(
                5 * minute if t["kind"] == "CARD_NOT_PRESENT" else 2 * minute)),
            "cloned_merchants": len({u["merchant"] for u in inside(10 * minute) if same(u)} - {t["merchant"]}),
            "known_devices": len(known), "device_known": device(t) in known if device(t) else False,
            "physical_count": sum(physical(u) for u in inside(5 * minute)),
            "remote_count": sum(not physical(u) for u in inside(5 * minute)),
            "hourly_spend": sum((u["amount"] for u in inside(60 * minute) if u["currency"] == t["currency"]), Decimal(0)),
            "daily_spend": sum((u["amount"] for u in daily), Decimal(0)), "baseline_count": len(base),
            "baseline_mean": float(mean), "baseline_stddev": math.sqrt(var),
            "conflict_latitude": newest and newest["lat"], "conflict_longitude": newest and newest["lon"],
        }
    return out


@pytest.mark.parametrize("mode", [EXACT, BUCKETED])
@pytest.mark.parametrize("skew", [SkewConfig(), SkewConfig(hot_rows=60, block_rows=40), SkewConfig(hot_rows=1, block_rows=8)],
                         ids=["ordinary", "mixed", "hot"])
def test_context_matches_a_plain_loop(spark, mode, skew):
    rows = history(seed=7)
    places = merchants(spark, [(m, *place, None, None) for m, place in PLACES.items()])
    found = {r["transaction_id"]: r for r in build_context(frame(spark, rows), places, CFG, mode, skew).collect()}
    wanted = expected(rows, mode)
    assert found.keys() == wanted.keys()
    for key, values in wanted.items():
        for name in FEATURES:
            got = found[key][name]
            if isinstance(values[name], float) and name.startswith("baseline"):
                assert got == pytest.approx(values[name], abs=1e-9, rel=1e-12), (key, name)
            else:
                assert got == values[name], (key, name)
