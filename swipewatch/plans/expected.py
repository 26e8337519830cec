"""The same results in plain SQL over the test tables: brute-force self-joins, no windows, no engine code.

Each statement is complete and reads whole tables. Parameters come from the catalog.
"""

from __future__ import annotations

from datetime import datetime

from swipewatch.config import HIGH_RISK_KEYWORDS, LIKELIHOOD_RATIOS, MEDIUM_RISK_KEYWORDS
from swipewatch.plans.catalog import (CURSOR_AT, CURSOR_ID, CUSTOMER, FROM, MERCHANT, RETENTION_AS_OF, RULE, RULE_KEYS,
                                      SINCE, TO, TRANSACTION)
from swipewatch.sources.demo import MERCHANTS, SPOILT, spoilt_sql

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def micros(moment: datetime) -> int:
    return int(moment.timestamp()) * 1_000_000


TX = """
ev AS (
  SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CAST(floor(value / 10) AS BIGINT) AS b, epoch_us(ts) - 1704067200000000 AS d
  FROM events),
tx AS (
  SELECT event_id, k,
    '00000000-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS transaction_id,
    'CUST-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS customer_id,
    'MERCH-' || lpad(CAST(k % 12 AS VARCHAR), 2, '0') AS merchant_id,
    b * 150 + 9 AS amount,
    CASE WHEN k % 10 = 0 THEN 'USD' ELSE 'ZAR' END AS currency,
    CASE WHEN k % 8 = 1 THEN 'RETAIL' WHEN k % 8 = 2 THEN 'GROCERY' WHEN k % 8 = 3 THEN 'FUEL'
         WHEN k % 8 = 4 THEN 'DINING'
         WHEN k % 8 = 5 THEN CASE WHEN k % 16 = 5 THEN 'CRYPTO_EXCHANGE' ELSE 'PHARMACY' END
         WHEN k % 8 = 6 THEN CASE WHEN k % 16 = 6 THEN 'GAMBLING' ELSE 'TRAVEL' END
         WHEN k % 8 = 7 THEN CASE WHEN k % 32 = 7 THEN 'WIRE_TRANSFER' ELSE 'ELECTRONICS' END END AS category,
    CASE WHEN k % 20 = 0 THEN NULL WHEN k % 50 = 1 THEN 64.1466 WHEN user_id % 3 = 0 THEN 38.7223
         WHEN user_id % 3 = 1 THEN 52.2297 ELSE 37.9838 END::DOUBLE AS latitude,
    CASE WHEN k % 20 = 0 THEN NULL WHEN k % 50 = 1 THEN -21.9426 WHEN user_id % 3 = 0 THEN -9.1393
         WHEN user_id % 3 = 1 THEN 21.0122 ELSE 23.7275 END::DOUBLE AS longitude,
    CASE WHEN k % 5 < 3 THEN NULL WHEN k % 40 = 4 THEN 'dev-new-' || event_id ELSE 'dev-' || user_id END AS device_fingerprint,
    1704067200000000 + (d // 604800000000) * 604800000000 + (user_id % 24) * 3600000000
      + (d % 604800000000) // 168 AS us,
    CASE event_type WHEN 'signup' THEN 'CONTACTLESS' WHEN 'purchase' THEN 'CARD_PRESENT' WHEN 'error' THEN 'ATM'
         ELSE 'CARD_NOT_PRESENT' END AS transaction_type
  FROM ev)"""

DIM = "dim(merchant_id, latitude, longitude, city, country) AS (VALUES {})".format(", ".join(
    f"('{m}', {lat}::DOUBLE, {lon}::DOUBLE, '{city}', '{country}')" for m, lat, lon, city, country in MERCHANTS))

LOCATED = """
located AS (
  SELECT t.*,
    CASE WHEN t.latitude IS NULL AND t.transaction_type <> 'CARD_NOT_PRESENT' THEN m.latitude END AS merchant_latitude,
    CASE WHEN t.latitude IS NULL AND t.transaction_type <> 'CARD_NOT_PRESENT' THEN m.longitude END AS merchant_longitude
  FROM tx t LEFT JOIN dim m USING (merchant_id)),
here AS (
  SELECT *, coalesce(latitude, merchant_latitude) AS effective_latitude,
    coalesce(longitude, merchant_longitude) AS effective_longitude FROM located)"""

PRIOR = "u.customer_id = t.customer_id AND (u.us < t.us OR (u.us = t.us AND u.transaction_id < t.transaction_id))"


def minutes(n: int) -> str:
    return f"u.us > t.us - {n * 60_000_000}"


FAR = """(6371.0 * 2 * atan2(sqrt(hav), sqrt(1 - hav))) / ((gap // 1000) / 3600000.0) > 900.0"""

RECENT = f"""
pairs AS (
  SELECT t.transaction_id AS id, t.us AS now, u.*, t.us - u.us AS gap,
    u.amount = t.amount AND u.currency = t.currency AS same_charge, u.merchant_id = t.merchant_id AS same_merchant,
    u.currency = t.currency AS same_currency,
    CASE WHEN t.transaction_type = 'CARD_NOT_PRESENT' THEN 300000000 ELSE 120000000 END AS dup_span,
    pow(sin(radians(u.latitude - t.effective_latitude) / 2), 2) + cos(radians(t.effective_latitude))
      * cos(radians(u.latitude)) * pow(sin(radians(u.longitude - t.effective_longitude) / 2), 2) AS hav,
    t.device_fingerprint AS own_device
  FROM here t JOIN tx u ON {PRIOR} AND {minutes(60)}),
recent AS (
  SELECT id AS transaction_id, count(*) AS recent_count,
    count(*) FILTER (gap < 600000000) AS velocity_count,
    count(*) FILTER (gap < 600000000) AS cross_merchant_count,
    count(*) FILTER (gap < 300000000 AND transaction_type <> 'CARD_NOT_PRESENT') AS physical_count,
    count(*) FILTER (gap < 300000000 AND transaction_type = 'CARD_NOT_PRESENT') AS remote_count,
    coalesce(bool_or(same_charge AND same_merchant AND gap < dup_span), false) AS duplicate_seen,
    count(DISTINCT merchant_id) FILTER (same_charge AND NOT same_merchant AND gap < 600000000) AS cloned_merchants,
    count(DISTINCT device_fingerprint) AS known_devices,
    coalesce(bool_or(device_fingerprint = own_device), false) AS device_known,
    coalesce(sum(amount) FILTER (same_currency), 0)::DOUBLE AS hourly_spend,
    arg_max(latitude, us) FILTER (gap >= 60000000 AND hav IS NOT NULL AND {FAR}) AS conflict_latitude,
    arg_max(longitude, us) FILTER (gap >= 60000000 AND hav IS NOT NULL AND {FAR}) AS conflict_longitude
  FROM pairs GROUP BY id)"""


def history(bucketed: bool = False, days: int = 90) -> str:
    day = (f"u.us // {HOUR_US} > t.us // {HOUR_US} - 24" if bucketed else f"u.us >= t.us - {DAY_US}")
    span = (f"u.us // {DAY_US} > t.us // {DAY_US} - {days}" if bucketed else f"u.us >= t.us - {days * DAY_US}")
    return f"""
history AS (
  SELECT t.transaction_id, coalesce(sum(u.amount) FILTER ({day}), 0)::DOUBLE AS daily_spend,
    count(u.amount) FILTER ({span}) AS baseline_count,
    coalesce(avg(u.amount) FILTER ({span}), 0)::DOUBLE AS baseline_mean,
    coalesce(stddev_pop(u.amount) FILTER ({span}), 0)::DOUBLE AS baseline_stddev
  FROM tx t LEFT JOIN tx u ON {PRIOR} AND u.currency = t.currency GROUP BY t.transaction_id)"""


CONTEXT = """
ctx AS (
  SELECT h.*, coalesce(recent_count, 0) AS recent_count, coalesce(velocity_count, 0) AS velocity_count,
    coalesce(cross_merchant_count, 0) AS cross_merchant_count, coalesce(physical_count, 0) AS physical_count,
    coalesce(remote_count, 0) AS remote_count, coalesce(duplicate_seen, false) AS duplicate_seen,
    coalesce(cloned_merchants, 0) AS cloned_merchants, coalesce(known_devices, 0) AS known_devices,
    coalesce(device_known, false) AS device_known, coalesce(hourly_spend, 0)::DOUBLE AS hourly_spend,
    conflict_latitude, conflict_longitude, daily_spend, baseline_count, baseline_mean, baseline_stddev
  FROM here h LEFT JOIN recent USING (transaction_id) JOIN history USING (transaction_id))"""


def contains(words) -> str:
    return "(" + " OR ".join(f"contains(upper(category), '{w}')" for w in words) + ")"


def verdict_ctes(hourly: int = 10_000, daily: int = 25_000) -> str:
    high, medium = contains(HIGH_RISK_KEYWORDS), contains(MEDIUM_RISK_KEYWORDS)
    conditions = [
        ("AMOUNT_THRESHOLD", 1, """CASE WHEN amount > CASE upper(category) WHEN 'RETAIL' THEN 15000 WHEN 'ELECTRONICS' THEN 15000
            WHEN 'TRAVEL' THEN 20000 WHEN 'GROCERY' THEN 3000 WHEN 'MONEY_TRANSFER' THEN 2000
            WHEN 'WIRE_TRANSFER' THEN 2000 ELSE 5000 END THEN 'HIGH' END"""),
        ("VELOCITY", 2, f"CASE WHEN velocity_count >= 5 THEN CASE WHEN {high} THEN 'CRITICAL' ELSE 'HIGH' END END"),
        ("DUPLICATE_TRANSACTION", 3, "CASE WHEN duplicate_seen THEN 'CRITICAL' END"),
        ("GEOGRAPHIC_ANOMALY", 5, "CASE WHEN conflict_latitude IS NOT NULL THEN 'CRITICAL' END"),
        ("CARD_CLONING", 6, "CASE WHEN cloned_merchants >= 2 THEN 'MEDIUM' END"),
        ("TIME_OF_DAY_ANOMALY", 7, f"CASE WHEN (us // {HOUR_US}) % 24 >= 23 OR (us // {HOUR_US}) % 24 < 5 THEN 'MEDIUM' END"),
        ("HIGH_RISK_MERCHANT_CATEGORY", 8, f"CASE WHEN {high} THEN 'HIGH' WHEN {medium} THEN 'MEDIUM' END"),
        ("DEVICE_FINGERPRINT", 9, """CASE WHEN device_fingerprint IS NOT NULL AND known_devices > 0 AND NOT device_known
            THEN 'HIGH' END"""),
        ("MULTI_CHANNEL_ANOMALY", 10, """CASE WHEN CASE WHEN transaction_type = 'CARD_NOT_PRESENT' THEN physical_count
            ELSE remote_count END > 0 THEN 'MEDIUM' END"""),
        ("CROSS_MERCHANT_VELOCITY", 11, "CASE WHEN cross_merchant_count + 1 >= 10 THEN 'MEDIUM' END"),
        ("CUMULATIVE_SPENDING", 12, f"""CASE WHEN hourly_spend + amount > {hourly} OR daily_spend + amount > {daily}
            THEN 'HIGH' END"""),
        ("CUSTOMER_AMOUNT_ANOMALY", 13, """CASE WHEN baseline_count >= 5 AND baseline_stddev >= 1e-9
            AND (amount - baseline_mean) / baseline_stddev > 3.0 THEN 'MEDIUM' END"""),
    ]
    union = "\n  UNION ALL ".join(
        f"SELECT transaction_id, '{name}' AS rule_name, {priority} AS priority, {sql} AS severity FROM ctx"
        for name, priority, sql in conditions)
    ratios = ", ".join(f"('{key.split(':')[0]}', '{key.split(':')[1]}', {ratio}::DOUBLE)"
                       for key, ratio in LIKELIHOOD_RATIOS.items())
    return f"""
ratios(rule_name, severity, ratio) AS (VALUES {ratios}),
violations AS (SELECT * FROM (
  {union}) WHERE severity IS NOT NULL),
evidence AS (
  SELECT transaction_id, count(*) AS n_violations, product(ratio) AS ratio,
    product(CASE severity WHEN 'LOW' THEN 1.3 WHEN 'MEDIUM' THEN 3.0 WHEN 'HIGH' THEN 9.0 ELSE 120.0 END) AS plain_ratio,
    string_agg(rule_name || ':' || severity, ',' ORDER BY priority) AS rules
  FROM violations JOIN ratios USING (rule_name, severity) GROUP BY transaction_id),
posterior AS (
  SELECT c.*, coalesce(n_violations, 0) AS n_violations, coalesce(rules, '') AS rules,
    coalesce(ratio, 1) / (99 + coalesce(ratio, 1)) AS p, coalesce(plain_ratio, 1) / (99 + coalesce(plain_ratio, 1)) AS plain_p
  FROM ctx c LEFT JOIN evidence USING (transaction_id)),
a AS (
  SELECT *, round(p, 9) AS fraud_probability,
    CAST(least(100, greatest(0, floor(100 * p + 0.5))) AS INTEGER) AS risk_score,
    CASE WHEN p >= 0.5 THEN 'FLAGGED' WHEN p >= 0.1 THEN 'PENDING_REVIEW' ELSE 'CLEARED' END AS disposition,
    'UNRESOLVED' AS outcome, us AS assessed_at_us
  FROM posterior)"""


def with_tx(select: str) -> str:
    return f"WITH {TX}\n{select}"


def with_context(select: str, bucketed: bool = False, days: int = 90) -> str:
    return f"WITH {TX},\n{DIM},{LOCATED},{RECENT},{history(bucketed, days)},{CONTEXT}\n{select}"


def with_verdicts(select: str, bucketed: bool = False, extra: str = "", **limits) -> str:
    more = f",\n{extra}" if extra else ""
    return (f"WITH {TX},\n{DIM},{LOCATED},{RECENT},{history(bucketed)},{CONTEXT},{verdict_ctes(**limits)}{more}\n{select}")


VERDICT_COLUMNS = ("transaction_id, customer_id, merchant_id, risk_score, fraud_probability, disposition, outcome,"
                   " assessed_at_us, rules")
TX_COLUMNS = ("transaction_id, customer_id, merchant_id, amount::DOUBLE AS amount, currency, category, latitude, longitude,"
              " device_fingerprint, us AS timestamp_us, transaction_type")
SLIM = "transaction_id, customer_id, merchant_id, risk_score, disposition, assessed_at_us"
CONTEXT_COLUMNS = """transaction_id, recent_count, velocity_count, cross_merchant_count, physical_count, remote_count,
  duplicate_seen, cloned_merchants, known_devices, device_known, hourly_spend, daily_spend, baseline_count,
  round(baseline_mean, 6) AS baseline_mean, round(baseline_stddev, 6) AS baseline_stddev,
  conflict_latitude, conflict_longitude, effective_latitude, effective_longitude"""

# --- raw events and what becomes of them -------------------------------------------------------------

RAW = """
raw AS (
  SELECT tx.transaction_id, customer_id, merchant_id,
    CASE WHEN event_id % 97 = 0 THEN 'not-a-number' ELSE amount || '.0000' END AS sent_amount,
    CASE WHEN event_id % 97 <> 0 THEN amount END AS amount,
    CASE WHEN event_id % 89 = 0 THEN 'TOOLONG' ELSE currency END AS currency,
    category, latitude, longitude, device_fingerprint, transaction_type, delivery, event_id, k,
    CASE WHEN event_id % 79 <> 0 THEN us END AS sent_us, us + 1000000 + (delivery - 1) * 1000000 AS ingest_ts_us
  FROM tx, (VALUES (1), (2)) AS d(delivery) WHERE delivery = 1 OR event_id % 83 = 0),
checked AS (
  SELECT *, coalesce(sent_us, ingest_ts_us) AS timestamp_us,
    CAST(event_id % 97 = 0 AS BIGINT) + CAST(event_id % 89 = 0 AS BIGINT) AS n_errors,
    concat_ws(',', CASE WHEN event_id % 97 = 0 THEN 'amount' END, CASE WHEN event_id % 89 = 0 THEN 'currency' END) AS fields
  FROM raw),
firsts AS (SELECT * FROM checked WHERE n_errors = 0 AND delivery = 1)"""


def with_raw(select: str) -> str:
    return f"WITH {TX},\n{RAW}\n{select}"


UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
SENT = "TRY_CAST(amount AS DECIMAL(38, 10))"
LONG_TEXTS = [("category", "length(category) > 64"), ("location", "length(location) > 128"), ("device_fingerprint", "length(device_fingerprint) > 128")]


def with_spoilt(checks: list[tuple[str, str]]) -> str:
    """Every check is on the values sent; which events are spoilt plays no part."""
    kinds = {"latitude": "DOUBLE", "longitude": "DOUBLE"}
    columns = ", ".join(f"{spoilt_sql(c, kinds.get(c, 'VARCHAR'))} AS {c}" for c in SPOILT)
    fields = ", ".join(f"CASE WHEN {failed} THEN '{field}' END" for field, failed in checks)
    count = " + ".join(f"CAST(coalesce({failed}, false) AS BIGINT)" for _, failed in checks)
    return f"""WITH {TX},
wire AS (SELECT event_id, transaction_id, customer_id, merchant_id, amount || '.0000' AS amount, currency, coalesce(category, '') AS category,
           '' AS location, coalesce(latitude, 0.0) AS latitude, coalesce(longitude, 0.0) AS longitude,
           coalesce(device_fingerprint, '') AS device_fingerprint, transaction_type FROM tx),
spoilt AS (SELECT event_id, {columns} FROM wire)
SELECT event_id, {count} AS n_errors, concat_ws(',', {fields}) AS fields FROM spoilt"""


def with_accepted_verdicts(select: str) -> str:
    """Verdicts as a stream reaches them that never saw the rejected events."""
    sent = TX.replace("\ntx AS (", "\nsent AS (")
    raw = RAW.replace("SELECT tx.transaction_id", "SELECT sent.transaction_id").replace("FROM tx,", "FROM sent,")
    tx = """
tx AS (SELECT event_id, k, transaction_id, customer_id, merchant_id, amount, currency, category, latitude, longitude,
         device_fingerprint, timestamp_us AS us, transaction_type FROM firsts)"""
    return f"WITH {sent},\n{raw},{tx},\n{DIM},{LOCATED},{RECENT},{history(bucketed=True)},{CONTEXT},{verdict_ctes()}\n{select}"


OUTCOMES = """
requests AS (
  SELECT event_id || '-1' AS event_id, event_id AS n, us + 3600000000 AS recorded_at_us,
    CASE k % 3 WHEN 0 THEN 'CONFIRMED_FRAUD' WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'UNRESOLVED' END AS requested
  FROM tx WHERE event_id % 10 = 0
  UNION ALL
  SELECT event_id || '-2', event_id, us + 7200000000,
    CASE k % 3 WHEN 0 THEN 'FALSE_POSITIVE' ELSE 'CONFIRMED_FRAUD' END FROM tx WHERE event_id % 20 = 0),
aimed AS (
  SELECT event_id, requested, recorded_at_us, '00000000-0000-0000-0000-' || lpad(CAST(
    n + CASE WHEN n % 50 = 0 THEN 10000000 ELSE 0 END AS VARCHAR), 12, '0') AS transaction_id FROM requests),
won AS (
  SELECT transaction_id, arg_min(requested, recorded_at_us) AS winner, arg_min(event_id, recorded_at_us) AS winning_event
  FROM aimed WHERE requested <> 'UNRESOLVED' GROUP BY transaction_id),
judged AS (
  SELECT a.* EXCLUDE (outcome), coalesce(winner, 'UNRESOLVED') AS outcome FROM a LEFT JOIN won USING (transaction_id))"""

RANGE = f"assessed_at_us >= {micros(FROM)} AND assessed_at_us <= {micros(TO)}"
SINCE_US = micros(SINCE)


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor({part} * 100.0::DOUBLE / {whole} * 100.0 + 0.5) / 100.0 ELSE 0.0 END::DOUBLE"


def instant(us: str) -> str:
    return f"""strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN ''
      WHEN {us} % 1000 = 0 THEN '.' || lpad(CAST({us} % 1000000 // 1000 AS VARCHAR), 3, '0')
      ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END || 'Z'"""


def cursor(us: str, row_id: str) -> str:
    return f"rtrim(replace(replace(to_base64(encode({instant(us)} || '|' || {row_id})), '+', '-'), '/', '_'), '=')"


def page(where: str, size: int = 20, order: str = "DESC", time: str = "assessed_at_us", source: str = "a",
         columns: str = "transaction_id, customer_id, merchant_id, assessed_at_us") -> str:
    return f"""
SELECT {columns}, CAST(position AS INTEGER) AS position, total > {size} AS has_more,
  CASE WHEN total > {size} THEN (SELECT {cursor('n.' + time, 'n.transaction_id')} FROM numbered n WHERE n.position = {size}) END AS next_cursor
FROM (SELECT *, (SELECT count(*) FROM numbered) AS total FROM numbered) WHERE position <= {size}""", f"""
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {time} {order}, transaction_id {order}) AS position FROM {source} WHERE {where})"""


def paged(*args, **kwargs) -> str:
    select, cte = page(*args, **kwargs)
    return with_verdicts(select, extra=cte.strip())


def summary(by: str) -> str:
    unique = "unique_customers, " if by == "merchant_id" else ""
    return with_verdicts(f"""
SELECT {by}, total_transactions, flagged_count, total_transactions - flagged_count AS not_flagged_count,
  {pct('flagged_count', 'total_transactions')} AS fraud_rate, highest_risk_score, {unique}
  coalesce(top_rules, '') AS top_rules, first_transaction_at_us, last_transaction_at_us
FROM (
  SELECT {by}, count(*) FILTER (us >= {SINCE_US}) AS total_transactions,
    count(*) FILTER (disposition = 'FLAGGED' AND assessed_at_us >= {SINCE_US}) AS flagged_count,
    coalesce(max(risk_score) FILTER (assessed_at_us >= {SINCE_US}), 0) AS highest_risk_score,
    count(DISTINCT customer_id) AS unique_customers,
    min(us) AS first_transaction_at_us, max(us) AS last_transaction_at_us FROM a GROUP BY {by})
LEFT JOIN (SELECT {by}, string_agg(rule_name, ',' ORDER BY rank) AS top_rules FROM ranked WHERE rank <= 3 GROUP BY {by})
  USING ({by})""", extra=ranked(by))


def ranked(by: str) -> str:
    return f"""counted AS (
  SELECT {by}, rule_name, count(*) AS n FROM a JOIN violations USING (transaction_id)
  WHERE assessed_at_us >= {SINCE_US} GROUP BY {by}, rule_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, rule_name) AS rank FROM counted)"""


def per_key(by: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_risk_summary": summary(by),
        f"{prefix}_txn_count": with_tx(
            f"SELECT {by}, count(*) FILTER (us >= {SINCE_US}) AS total_transactions FROM tx GROUP BY {by}"),
        f"{prefix}_flagged_count": with_verdicts(f"""SELECT {by}, count(*) FILTER (disposition = 'FLAGGED'
            AND assessed_at_us >= {SINCE_US}) AS flagged_count FROM a GROUP BY {by}"""),
        f"{prefix}_max_score": with_verdicts(f"""SELECT {by}, coalesce(max(risk_score)
            FILTER (assessed_at_us >= {SINCE_US}), 0) AS highest_risk_score FROM a GROUP BY {by}"""),
        f"{prefix}_top_rules": with_verdicts(
            f"SELECT {by}, rule_name, n, rank FROM ranked WHERE rank <= 3", extra=ranked(by)),
        f"{prefix}_first_last": with_tx(f"""SELECT {by}, min(us) AS first_transaction_at_us,
            max(us) AS last_transaction_at_us FROM tx GROUP BY {by}"""),
    }


ASSESS = with_verdicts(f"SELECT {VERDICT_COLUMNS} FROM a")
ASSESS_BUCKETED = with_verdicts(f"SELECT {VERDICT_COLUMNS} FROM a", bucketed=True)


def baseline(bucketed: bool, days: int = 90) -> str:
    return f"WITH {TX},{history(bucketed, days)}\n" + (
        "SELECT transaction_id, baseline_count, round(baseline_mean, 6) AS baseline_mean,"
        " round(baseline_stddev, 6) AS baseline_stddev FROM history")


def spend(bucketed: bool) -> str:
    return f"WITH {TX},{history(bucketed)}\nSELECT transaction_id, daily_spend FROM history"


def rule(name: str, **limits) -> str:
    return with_verdicts(f"SELECT transaction_id, severity FROM violations WHERE rule_name = '{name}'", **limits)



# name, priority, number of settings
RULE_LIST = """('AMOUNT_THRESHOLD', 1, 2::BIGINT), ('VELOCITY', 2, 2), ('DUPLICATE_TRANSACTION', 3, 2),
  ('GEOGRAPHIC_ANOMALY', 5, 2), ('CARD_CLONING', 6, 2), ('TIME_OF_DAY_ANOMALY', 7, 2), ('HIGH_RISK_MERCHANT_CATEGORY', 8, 2),
  ('DEVICE_FINGERPRINT', 9, 1), ('MULTI_CHANNEL_ANOMALY', 10, 1), ('CROSS_MERCHANT_VELOCITY', 11, 2),
  ('CUMULATIVE_SPENDING', 12, 3), ('CUSTOMER_AMOUNT_ANOMALY', 13, 3)"""

# events 97 and 89 are rejected, so they have no assessment
ASSESSED = "CAST(right(transaction_id, 12) AS BIGINT) % 97 <> 0 AND CAST(right(transaction_id, 12) AS BIGINT) % 89 <> 0"

EXPECTED = {
    "assess": ASSESS,
    "assess_bucketed": ASSESS_BUCKETED,
    "assess_hot_customers": ASSESS,
    "assess_incremental": f"SELECT * FROM ({ASSESS}) WHERE assessed_at_us >= {SINCE_US}",
    "assess_from_buckets": f"SELECT * FROM ({ASSESS_BUCKETED}) WHERE assessed_at_us >= {micros(CURSOR_AT)}",
    "assess_bucketed_hot_customers": ASSESS_BUCKETED,
    "stream_assess": ASSESS_BUCKETED,
    "stream_metrics": with_accepted_verdicts("""
SELECT 'arrived' AS metric, '' AS tag, count(*) AS value FROM raw
UNION ALL SELECT 'dead_letters', '', count(*) FROM checked WHERE n_errors > 0
UNION ALL SELECT 'duplicate_deliveries', '', count(*) FROM checked WHERE n_errors = 0 AND delivery > 1
UNION ALL SELECT 'assessments', disposition, count(*) FROM a GROUP BY disposition
UNION ALL SELECT 'violations', rule_name, count(*) FROM violations GROUP BY rule_name"""),
    "stream_redelivery": ASSESS_BUCKETED,
    "scan_transactions": with_tx(f"SELECT {TX_COLUMNS} FROM tx"),
    "normalise_events": with_raw("""SELECT transaction_id, customer_id, merchant_id, amount::DOUBLE AS amount, currency,
        category, latitude, longitude, device_fingerprint, timestamp_us, transaction_type, delivery, ingest_ts_us FROM checked"""),
    "validate_stream": with_spoilt([
        ("transaction_id", f"transaction_id IS NULL OR NOT regexp_full_match(transaction_id, '{UUID}')"),
        ("amount", "TRY_CAST(amount AS DECIMAL(19, 4)) IS NULL"), ("customer_id", "customer_id IS NULL"),
        ("merchant_id", "merchant_id IS NULL"), ("currency", "currency IS NULL"), ("customer_id", "length(customer_id) > 64"),
        ("merchant_id", "length(merchant_id) > 64"), ("currency", "length(currency) > 3"), *LONG_TEXTS]),
    "validate_submit": with_spoilt([
        ("transaction_id", f"NOT regexp_full_match(transaction_id, '{UUID}')"),
        ("customer_id", "coalesce(trim(customer_id, ' ' || chr(9)), '') = ''"), ("merchant_id", "coalesce(trim(merchant_id, ' ' || chr(9)), '') = ''"),
        ("amount", f"{SENT} IS NULL"), ("amount", f"{SENT} <= 0"), ("amount", f"abs({SENT}) >= 1000000000000000 OR {SENT} <> round({SENT}, 4)"),
        ("currency", "currency IS NULL OR NOT regexp_full_match(currency, '[A-Z]{3}')"),
        ("transaction_type", "transaction_type NOT IN ('CARD_PRESENT', 'CARD_NOT_PRESENT', 'CONTACTLESS', 'ATM')"),
        ("latitude", "abs(latitude) > 90"), ("longitude", "abs(longitude) > 180"), ("customer_id", "length(customer_id) > 64"),
        ("merchant_id", "length(merchant_id) > 64"), *LONG_TEXTS]),
    "quarantine": with_raw("""SELECT transaction_id, delivery, sent_amount, currency, concat_ws('; ',
        CASE WHEN event_id % 97 = 0 THEN 'amount: not a number of at most 15 and 4 digits' END,
        CASE WHEN event_id % 89 = 0 THEN 'currency: longer than 3' END) AS reason, 3 AS attempts, 'FAILED' AS status
        FROM checked WHERE n_errors > 0"""),
    "dedupe_transactions": with_raw(
        "SELECT transaction_id, customer_id, amount::DOUBLE AS amount, delivery, ingest_ts_us FROM firsts"),
    "duplicate_deliveries": with_raw("""SELECT transaction_id, count(*) - 1 AS repeats FROM checked WHERE n_errors = 0
        GROUP BY transaction_id HAVING count(*) > 1"""),
    "resubmitted_assessments": with_verdicts(f"""SELECT {VERDICT_COLUMNS} FROM a WHERE transaction_id IN (
        SELECT transaction_id FROM tx WHERE event_id % 83 = 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0)"""),
    "assign_missing_ids": with_tx("""SELECT CASE WHEN device_fingerprint LIKE 'dev-new%' THEN concat_ws('-', substr(h, 1, 8),
        substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) ELSE transaction_id END AS transaction_id,
        customer_id, merchant_id, us AS sent_us FROM (SELECT *, sha256(concat_ws(chr(31), customer_id, merchant_id,
          amount || '.0000', currency, CAST(us AS VARCHAR))) AS h FROM tx)"""),
    "merchant_dim": f"""WITH {TX},\n{DIM} SELECT merchant_id, n, latitude, longitude, city, country,
        city IS NOT NULL AS known FROM (SELECT merchant_id, count(*) AS n FROM tx GROUP BY merchant_id)
        LEFT JOIN dim USING (merchant_id)""",
    "write_assessments": with_verdicts("""SELECT transaction_id AS assessment_id, row_number() OVER (
        PARTITION BY transaction_id ORDER BY priority) - 1 AS position, rule_name, '1.0' AS rule_version, severity
        FROM violations"""),
    "route_flagged": with_verdicts(
        "SELECT transaction_id, customer_id, risk_score, assessed_at_us FROM a WHERE disposition = 'FLAGGED'"),
    "route_pending_review": with_verdicts("""SELECT transaction_id, customer_id, merchant_id, currency, transaction_type,
        risk_score, amount::DOUBLE AS amount, assessed_at_us FROM a WHERE disposition = 'PENDING_REVIEW'"""),
    "route_cleared": with_verdicts("""SELECT transaction_id, customer_id, merchant_id, currency, transaction_type,
        amount::DOUBLE AS amount, us AS timestamp_us FROM a WHERE disposition = 'CLEARED'"""),
    "write_daily_partitions": with_tx("""SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS event_date, count(*) AS n,
        sum(amount)::DOUBLE AS total FROM tx GROUP BY 1"""),
    "split_retention": with_tx(f"""SELECT CASE WHEN CAST(make_timestamp(us) AS DATE) > DATE '{RETENTION_AS_OF}' - 91
        THEN 'active' ELSE 'archived' END AS part, strftime(make_timestamp(us), '%Y-%m-%d') AS event_date, count(*) AS n
        FROM tx GROUP BY 1, 2"""),
    "status_counts": with_raw("""SELECT status, count(*) AS n FROM (SELECT transaction_id, CASE WHEN max(n_errors) > 0
        THEN 'FAILED' ELSE 'ASSESSED' END AS status FROM checked GROUP BY transaction_id) GROUP BY status"""),
    "filter_optional_and": with_verdicts(f"""SELECT {SLIM} FROM a WHERE disposition = 'FLAGGED'
        AND merchant_id = '{MERCHANT}' AND risk_score >= 60 AND assessed_at_us >= {micros(FROM)}"""),
    "filter_time_range": with_verdicts(f"SELECT {SLIM} FROM a WHERE {RANGE}"),
    "filter_score_band": with_verdicts(f"SELECT {SLIM} FROM a WHERE risk_score BETWEEN 10 AND 60"),
    "lookup_transaction": with_tx(f"SELECT {TX_COLUMNS} FROM tx WHERE transaction_id = '{TRANSACTION}'"),
    "lookup_assessment": with_verdicts(f"SELECT {VERDICT_COLUMNS} FROM a WHERE transaction_id = '{TRANSACTION}'"),
    "project_transaction_summary": with_verdicts(f"SELECT {TX_COLUMNS}, risk_score, disposition, outcome FROM a"),
    "project_assessment": ASSESS,
    "filter_resolved": with_verdicts(
        "SELECT transaction_id, disposition, outcome FROM judged WHERE outcome <> 'UNRESOLVED'", extra=OUTCOMES),
    "history_with_assessment": with_verdicts(f"""SELECT transaction_id, customer_id, us AS timestamp_us,
        CASE WHEN {ASSESSED} THEN risk_score END AS risk_score,
        CASE WHEN {ASSESSED} THEN n_violations ELSE 0 END AS n_violations FROM a"""),
    "assessment_details": with_verdicts("""SELECT transaction_id AS assessment_id, transaction_id, category, latitude,
        longitude, device_fingerprint, risk_score, n_violations FROM a"""),
    # the rules of a row are already one text there, so the violations are not worked out a second time
    "semi_join_rule": with_verdicts(f"SELECT {SLIM} FROM a WHERE contains(',' || rules, ',{RULE}:')"),
    "nested_rule_filter": with_verdicts(f"SELECT {SLIM} FROM a WHERE contains(',' || rules, ',{RULE}:')"),
    "merchant_fallback": f"WITH {TX},\n{DIM},{LOCATED}\nSELECT transaction_id, merchant_latitude, merchant_longitude FROM here",
    "violations_join": with_verdicts("SELECT rule_name, severity, count(*) AS n FROM violations GROUP BY ALL"),
    "recent_context": with_context("""SELECT transaction_id, recent_count, velocity_count, cross_merchant_count,
        physical_count, remote_count, hourly_spend FROM ctx"""),
    "recent_transactions": with_tx(f"""SELECT u.transaction_id, u.merchant_id, u.amount::DOUBLE AS amount, u.currency, u.us
        FROM tx t JOIN tx u ON {PRIOR} AND {minutes(60)} WHERE t.transaction_id = '{TRANSACTION}'"""),
    "daily_spend_exact": spend(False),
    "daily_spend_bucketed": spend(True),
    "baseline_exact": baseline(False),
    "baseline_bucketed": baseline(True),
    "baseline_exact_10_days": baseline(False, 10),
    "baseline_bucketed_10_days": baseline(True, 10),
    "hourly_buckets": with_tx(f"""SELECT customer_id, currency, us // {HOUR_US} AS epoch_hour,
        sum(amount)::DOUBLE AS spend FROM tx GROUP BY ALL"""),
    "daily_buckets": with_tx(f"""SELECT customer_id, currency, us // {DAY_US} AS epoch_day, count(*) AS n,
        sum(amount)::DOUBLE AS total, sum(amount * amount)::DOUBLE AS squares FROM tx GROUP BY ALL"""),
    "windowed_spend": with_tx(f"""SELECT customer_id, currency, us // {HOUR_US} * {HOUR_US} AS starts_at_us,
        sum(amount)::DOUBLE AS spend, count(*) AS n FROM tx GROUP BY ALL"""),
    "effective_location": f"""WITH {TX},\n{DIM},{LOCATED}
        SELECT transaction_id, effective_latitude, effective_longitude FROM here""",
    "context_bundle": with_context(f"SELECT {CONTEXT_COLUMNS} FROM ctx"),
    "context_bundle_bucketed": with_context(f"SELECT {CONTEXT_COLUMNS} FROM ctx", bucketed=True),
    "context_bundle_hot_customers": with_context(f"SELECT {CONTEXT_COLUMNS} FROM ctx"),
    **{key: rule(name) for key, name in RULE_KEYS.items()},
    "rule_cumulative_spending_daily": rule("CUMULATIVE_SPENDING", hourly=10 ** 9, daily=8000),
    "evaluate_rules": with_verdicts("SELECT transaction_id, rules FROM a"),
    "list_rules": with_verdicts("""SELECT l.rule_name, '1.0' AS rule_version, l.priority, true AS enabled, n_settings,
        count(v.transaction_id) AS fired FROM listed l LEFT JOIN violations v ON v.rule_name = l.rule_name
        GROUP BY l.rule_name, l.priority, n_settings""",
                                extra=f"listed(rule_name, priority, n_settings) AS (VALUES {RULE_LIST})"),
    "likelihood_ratio": with_verdicts("""SELECT rule_name, severity, ratio, count(*) AS n
        FROM violations JOIN ratios USING (rule_name, severity) GROUP BY ALL"""),
    "severity_fallback": with_verdicts("""SELECT transaction_id,
        CAST(least(100, greatest(0, floor(100 * plain_p + 0.5))) AS INTEGER) AS risk_score,
        CASE WHEN plain_p >= 0.5 THEN 'FLAGGED' WHEN plain_p >= 0.1 THEN 'PENDING_REVIEW' ELSE 'CLEARED' END AS disposition
        FROM posterior"""),
    "fraud_probability": with_verdicts("SELECT transaction_id, fraud_probability FROM a"),
    "risk_score": with_verdicts("SELECT risk_score, count(*) AS n FROM a GROUP BY risk_score"),
    "disposition": with_verdicts("SELECT transaction_id, disposition FROM a"),
    "count_assessed": with_verdicts(f"SELECT count(*) AS n FROM a WHERE {RANGE}"),
    "count_flagged": with_verdicts(f"SELECT count(*) AS n FROM a WHERE disposition = 'FLAGGED' AND {RANGE}"),
    "rule_breakdown": with_verdicts(f"""SELECT rule_name, count(DISTINCT transaction_id) AS flagged_count,
        {pct('count(DISTINCT transaction_id)', 'any_value(total)')} AS percentage
        FROM violations JOIN a USING (transaction_id),
          (SELECT count(*) AS total FROM a WHERE disposition = 'FLAGGED' AND {RANGE})
        WHERE disposition = 'FLAGGED' AND {RANGE} GROUP BY rule_name"""),
    "fraud_summary": with_verdicts(f"""SELECT total AS total_assessed, flagged AS total_flagged,
        total - flagged AS total_not_flagged, {pct('flagged', 'total')} AS fraud_rate, breakdown
        FROM (SELECT count(*) AS total, count(*) FILTER (disposition = 'FLAGGED') AS flagged FROM a WHERE {RANGE}),
          (SELECT string_agg(rule_name || '=' || n, ',' ORDER BY n DESC, rule_name) AS breakdown FROM (
            SELECT rule_name, count(DISTINCT transaction_id) AS n FROM violations JOIN a USING (transaction_id)
            WHERE disposition = 'FLAGGED' AND {RANGE} GROUP BY rule_name))"""),
    **per_key("customer_id", "customer"),
    **per_key("merchant_id", "merchant"),
    "merchant_unique_customers": with_tx(
        "SELECT merchant_id, count(DISTINCT customer_id) AS unique_customers FROM tx GROUP BY merchant_id"),
    "disposition_counts": with_verdicts("SELECT disposition, count(*) AS n FROM a GROUP BY disposition"),
    "operational_metrics": with_verdicts("""
        SELECT 'assessments' AS metric, disposition AS tag, count(*) AS value FROM a JOIN firsts USING (transaction_id)
          GROUP BY disposition
        UNION ALL SELECT 'dead_letters', '', count(*) FROM checked WHERE n_errors > 0
        UNION ALL SELECT 'duplicate_deliveries', '', count(*) FROM checked WHERE n_errors = 0 AND delivery = 2""",
                                      extra=RAW.strip()),
    "detection_metrics": with_verdicts("""SELECT tp, fn, fp, tn, round(tp / (tp + fn)::DOUBLE, 9) AS sensitivity,
        round(tn / (tn + fp)::DOUBLE, 9) AS specificity, round(tp / (tp + fp)::DOUBLE, 9) AS precision,
        round(fp / (fp + tn)::DOUBLE, 9) AS false_positive_rate, round(fn / (fn + tp)::DOUBLE, 9) AS false_negative_rate,
        round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM (SELECT
          count(*) FILTER (disposition = 'FLAGGED' AND outcome = 'CONFIRMED_FRAUD') AS tp,
          count(*) FILTER (disposition <> 'FLAGGED' AND outcome = 'CONFIRMED_FRAUD') AS fn,
          count(*) FILTER (disposition = 'FLAGGED' AND outcome = 'FALSE_POSITIVE') AS fp,
          count(*) FILTER (disposition <> 'FLAGGED' AND outcome = 'FALSE_POSITIVE') AS tn FROM judged)""", extra=OUTCOMES.strip()),
    "pattern_coverage": with_verdicts("""SELECT rule_name, count(transaction_id) AS fired, count(transaction_id) > 0 AS covered
        FROM (SELECT DISTINCT rule_name FROM ratios) LEFT JOIN violations USING (rule_name) GROUP BY rule_name"""),
    "feed_customer_history": paged(
        f"customer_id = '{CUSTOMER}' AND us >= {micros(FROM)} AND us <= {micros(TO)}", 10, "ASC", "us",
        columns="transaction_id, merchant_id, us AS timestamp_us, risk_score, disposition"),
    "feed_flagged": paged(f"""disposition = 'FLAGGED' AND risk_score BETWEEN 57 AND 99 AND {RANGE}
        AND transaction_id IN (SELECT transaction_id FROM violations WHERE rule_name = '{RULE}')""", 50),
    "feed_pending_review": paged("disposition = 'PENDING_REVIEW' AND risk_score >= 11", 25, "ASC"),
    "feed_passed": paged(f"disposition = 'CLEARED' AND risk_score >= 2 AND assessed_at_us >= {micros(FROM)}"),
    "feed_merchant_flagged": paged(f"disposition = 'FLAGGED' AND merchant_id = '{MERCHANT}'", 1000),
    "keyset_page": paged(f"""assessed_at_us < {micros(CURSOR_AT)}
        OR (assessed_at_us = {micros(CURSOR_AT)} AND transaction_id < '{CURSOR_ID}')""", 100),
    "feed_pages": with_verdicts("""SELECT transaction_id, n AS row_number, CAST(ceil(n / 20.0) AS BIGINT) AS page FROM (
        SELECT transaction_id, row_number() OVER (ORDER BY assessed_at_us DESC, transaction_id DESC) AS n
        FROM a WHERE disposition = 'FLAGGED')"""),
    "cursor_codec": with_verdicts(f"SELECT transaction_id, {cursor('assessed_at_us', 'transaction_id')} AS cursor FROM a"),
    "top_k_rules": with_verdicts(
        "SELECT rule_name, count(*) AS n FROM violations GROUP BY rule_name ORDER BY n DESC, rule_name LIMIT 3"),
    "resolve_outcomes": with_verdicts("SELECT transaction_id, disposition, outcome FROM judged", extra=OUTCOMES.strip()),
    "outcome_status": with_verdicts("""SELECT event_id, transaction_id, requested, recorded_at_us, status,
        CASE WHEN status IN ('APPLIED', 'CONFLICT') THEN winner END AS standing_outcome FROM (
          SELECT m.event_id, m.transaction_id, requested, recorded_at_us, winner, CASE WHEN requested = 'UNRESOLVED' THEN 'INVALID'
            WHEN a.transaction_id IS NULL THEN 'NOT_FOUND' WHEN m.event_id = winning_event THEN 'APPLIED' ELSE 'CONFLICT' END AS status
          FROM aimed m LEFT JOIN won USING (transaction_id) LEFT JOIN a USING (transaction_id))""", extra=OUTCOMES.strip()),
    "outcome_log": with_verdicts("""SELECT event_id, transaction_id, requested, recorded_at_us, status,
        CASE WHEN status IN ('APPLIED', 'CONFLICT') THEN winner END AS standing_outcome FROM (
          SELECT m.event_id, m.transaction_id, requested, recorded_at_us, winner, CASE WHEN requested = 'UNRESOLVED' THEN 'INVALID'
            WHEN a.transaction_id IS NULL THEN 'NOT_FOUND' WHEN m.event_id = winning_event THEN 'APPLIED' ELSE 'CONFLICT' END AS status
          FROM aimed m LEFT JOIN won USING (transaction_id) LEFT JOIN a USING (transaction_id))""", extra=OUTCOMES.strip()),
    "outcome_counts": with_verdicts(
        "SELECT disposition, outcome, count(*) AS n FROM judged GROUP BY ALL", extra=OUTCOMES.strip()),
}
