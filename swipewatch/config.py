"""Rule, scoring and skew settings. Defaults are the published ones; every
invalid combination fails when the object is built, before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from types import MappingProxyType

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Amount limits per category, keyword lists and likelihood ratios.
CATEGORY_THRESHOLDS = MappingProxyType({
    "RETAIL": Decimal(15000),
    "ELECTRONICS": Decimal(15000),
    "TRAVEL": Decimal(20000),
    "GROCERY": Decimal(3000),
    "MONEY_TRANSFER": Decimal(2000),
    "WIRE_TRANSFER": Decimal(2000),
})
HIGH_RISK_KEYWORDS = ("CRYPTO", "CRYPTOCURRENCY", "CRYPTO_EXCHANGE", "MONEY_TRANSFER", "WIRE_TRANSFER")
MEDIUM_RISK_KEYWORDS = ("GAMBLING", "CASINO", "BETTING", "PAYDAY_LOAN")
LIKELIHOOD_RATIOS = MappingProxyType({
    "AMOUNT_THRESHOLD:HIGH": 2.0,
    "VELOCITY:HIGH": 130.0,
    "VELOCITY:CRITICAL": 300.0,
    "DUPLICATE_TRANSACTION:CRITICAL": 150.0,
    "GEOGRAPHIC_ANOMALY:CRITICAL": 400.0,
    "CARD_CLONING:MEDIUM": 6.0,
    "TIME_OF_DAY_ANOMALY:MEDIUM": 3.0,
    "HIGH_RISK_MERCHANT_CATEGORY:HIGH": 130.0,
    "HIGH_RISK_MERCHANT_CATEGORY:MEDIUM": 5.0,
    "DEVICE_FINGERPRINT:HIGH": 160.0,
    "MULTI_CHANNEL_ANOMALY:MEDIUM": 5.0,
    "CROSS_MERCHANT_VELOCITY:MEDIUM": 3.0,
    "CUMULATIVE_SPENDING:HIGH": 140.0,
    "CUSTOMER_AMOUNT_ANOMALY:MEDIUM": 5.0,
})
SEVERITY_RATIOS = MappingProxyType({"LOW": 1.3, "MEDIUM": 3.0, "HIGH": 9.0, "CRITICAL": 120.0})


@dataclass(frozen=True)
class RuleConfig:
    lookback_minutes: int = 60
    amount_threshold: Decimal = Decimal(5000)
    category_thresholds: MappingProxyType = CATEGORY_THRESHOLDS
    velocity_max: int = 5
    velocity_minutes: int = 10
    duplicate_physical_seconds: int = 120
    duplicate_remote_seconds: int = 300
    geographic_minutes: int = 60
    geographic_max_kmh: float = 900.0
    multi_channel_minutes: int = 5
    device_minutes: int = 60
    cloning_minutes: int = 10
    cloning_other_merchants: int = 2
    off_hours_start: int = 23
    off_hours_end: int = 5
    high_risk_keywords: tuple = HIGH_RISK_KEYWORDS
    medium_risk_keywords: tuple = MEDIUM_RISK_KEYWORDS
    cross_merchant_max: int = 10
    cross_merchant_minutes: int = 10
    hourly_minutes: int = 60
    hourly_limit: Decimal = Decimal(10000)
    daily_limit: Decimal = Decimal(25000)
    baseline_days: int = 90
    baseline_min_count: int = 5
    baseline_sigmas: float = 3.0
    disabled: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        # Windows over the recent-activity context cannot look further back than it does;
        # the baseline has its own, independent span.
        seconds = {
            "velocity_minutes": self.velocity_minutes * 60,
            "duplicate_physical_seconds": self.duplicate_physical_seconds,
            "duplicate_remote_seconds": self.duplicate_remote_seconds,
            "geographic_minutes": self.geographic_minutes * 60,
            "multi_channel_minutes": self.multi_channel_minutes * 60,
            "device_minutes": self.device_minutes * 60,
            "cloning_minutes": self.cloning_minutes * 60,
            "cross_merchant_minutes": self.cross_merchant_minutes * 60,
            "hourly_minutes": self.hourly_minutes * 60,
        }
        too_wide = sorted(name for name, span in seconds.items() if span > self.lookback_minutes * 60)
        if too_wide:
            raise ValueError(f"wider than the {self.lookback_minutes}-minute lookback: {', '.join(too_wide)}")
        not_positive = sorted(name for name, span in seconds.items() if span <= 0)
        if not_positive or self.baseline_days <= 0:
            raise ValueError(f"windows must be positive: {', '.join(not_positive) or 'baseline_days'}")
        for hour in (self.off_hours_start, self.off_hours_end):
            if not 0 <= hour <= 23:
                raise ValueError(f"hour out of range: {hour}")


@dataclass(frozen=True)
class ScoringConfig:
    prior: float = 0.01
    review_threshold: float = 0.10
    flag_threshold: float = 0.50
    likelihood_ratios: MappingProxyType = LIKELIHOOD_RATIOS
    severity_ratios: MappingProxyType = SEVERITY_RATIOS

    def __post_init__(self):
        if not 0.0 < self.prior < 1.0:
            raise ValueError("prior must lie strictly between 0 and 1")
        if not self.review_threshold < self.flag_threshold:
            raise ValueError("review_threshold must be below flag_threshold")
        ratios = list(self.likelihood_ratios.values()) + list(self.severity_ratios.values())
        if min(ratios) <= 0.0:
            raise ValueError("likelihood ratios must be positive")


@dataclass(frozen=True)
class SkewConfig:
    """When a customer counts as hot, and how finely their timeline is cut.

    A customer with ``hot_rows`` rows or more, or with ``dense_rows`` or more in one hour, is hot; there may be any
    number of them. Every other customer fits one task, and the list of an hour that each of their rows is compared
    with stays below ``dense_rows``. Which way a customer goes changes the cost, not the result.
    """

    hot_rows: int = 200_000
    dense_rows: int = 2_000
    block_rows: int = 1_000_000

    def __post_init__(self):
        if min(self.hot_rows, self.dense_rows, self.block_rows) < 1:
            raise ValueError("skew settings must be positive")
