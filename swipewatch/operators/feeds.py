"""Filtered, keyset-paged views of transactions and assessments."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipewatch.functions.cursor import decode_cursor, encode_cursor
from swipewatch.operators.rules import RULES, rule_named
from swipewatch.schemas import CLEARED, DISPOSITIONS, UNRESOLVED
from swipewatch.sources import tables

DEFAULT_PAGE, MAX_PAGE = 20, 1000  # fixed values


# --- filters: only what is given reaches the plan -------------------------------------------------

def where_all(frame: DataFrame, predicates: list[Column]) -> DataFrame:
    return frame.where(reduce(lambda a, b: a & b, predicates)) if predicates else frame


def time_range(column: str, from_: datetime | None, to: datetime | None) -> list[Column]:
    """Both ends inclusive."""
    if from_ is not None and to is not None and to < from_:
        raise ValueError(f"'to' ({to}) must not be before 'from' ({from_})")
    return ([F.col(column) >= F.lit(from_)] if from_ is not None else []) + \
        ([F.col(column) <= F.lit(to)] if to is not None else [])


def score_band(low: int | None, high: int | None) -> list[Column]:
    return ([F.col("risk_score") >= low] if low is not None else []) + \
        ([F.col("risk_score") <= high] if high is not None else [])


def broke_rule(name: str | None, rules=RULES) -> list[Column]:
    """Assessments violating a rule, which must be a registered one. Looks inside the row; no join needed."""
    if name is None:
        return []
    rule_named(name, rules)
    return [F.exists("violations", lambda v: v.rule_name == name)]


def equal_to(**values) -> list[Column]:
    return [F.col(name) == value for name, value in values.items() if value is not None]


def resolved(assessments: DataFrame) -> DataFrame:
    return assessments.where(F.col("outcome") != UNRESOLVED)


def lookup(frame: DataFrame, transaction_id: str) -> DataFrame:
    return frame.where(F.col("transaction_id") == transaction_id.lower())


# --- joins ----------------------------------------------------------------------------------------

def history_with_assessment(txns: DataFrame, assessments: DataFrame) -> DataFrame:
    """Every transaction with its assessment nested, NULL while there is none."""
    nested = assessments.select("transaction_id", F.struct(
        "assessment_id", "risk_score", "disposition", "outcome", "assessed_at", "violations").alias("assessment"))
    return txns.join(nested, "transaction_id", "left")


def assessment_details(txns: DataFrame, assessments: DataFrame) -> DataFrame:
    """Assessments with the full row of their transaction."""
    own = [c for c in assessments.columns if c == "transaction_id" or c not in txns.columns]
    return assessments.select(*own).join(txns, "transaction_id")


def semi_join_rule(assessments: DataFrame, violations: DataFrame, rule: str) -> DataFrame:
    """The same as :func:`broke_rule` over a separate violations table."""
    rule_named(rule)
    hits = violations.where(F.col("rule_name") == rule).select("assessment_id")
    return assessments.join(hits, "assessment_id", "left_semi")


# --- paging ---------------------------------------------------------------------------------------

def keyset_page(rows: DataFrame, time: str, row_id: str, cursor: str | None = None,
                page_size: int = DEFAULT_PAGE, sort: str = "desc") -> DataFrame:
    """The page strictly after ``cursor``, with ``has_more`` and ``next_cursor`` on every row.

    Spark keeps the best ``page_size + 1`` rows per task; the page columns are
    then worked out on those few rows alone.
    """
    if not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"page size must lie within 1 and {MAX_PAGE}")
    if sort not in ("asc", "desc"):
        raise ValueError("sort must be 'asc' or 'desc'")
    if cursor is not None:
        moment, last_id = decode_cursor(cursor)
        at, tie = F.lit(moment), F.lit(last_id)
        rows = rows.where((F.col(time) < at) | ((F.col(time) == at) & (F.col(row_id) < tie)) if sort == "desc"
                          else (F.col(time) > at) | ((F.col(time) == at) & (F.col(row_id) > tie)))
    order = [F.col(c).desc() if sort == "desc" else F.col(c).asc() for c in (time, row_id)]
    best = rows.orderBy(*order).limit(page_size + 1)
    numbered = best.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    everything = Window.partitionBy()
    more = F.count(F.lit(1)).over(everything) > page_size
    last = F.max(F.when(F.col("position") == page_size, encode_cursor(F.unix_micros(time), F.col(row_id)))).over(everything)
    return (numbered.withColumns({"has_more": more, "next_cursor": last})
            .where(F.col("position") <= page_size)
            .withColumn("next_cursor", F.when(F.col("has_more"), F.col("next_cursor"))))


def feed(assessments: DataFrame, disposition: str, *, customer_id: str | None = None, merchant_id: str | None = None,
         rule: str | None = None, min_score: int | None = None, max_score: int | None = None,
         from_: datetime | None = None, to: datetime | None = None, cursor: str | None = None,
         page_size: int = DEFAULT_PAGE, sort: str = "desc") -> DataFrame:
    """One page of assessments with this verdict. Cleared ones filter by customer, lowest score and time only."""
    if disposition not in DISPOSITIONS:
        raise ValueError(f"unknown disposition {disposition!r}")
    if disposition == CLEARED and (rule is not None or max_score is not None or merchant_id is not None):
        raise ValueError("the cleared feed has no rule, merchant or highest-score filter")
    chosen = where_all(assessments, equal_to(disposition=disposition, customer_id=customer_id, merchant_id=merchant_id)
                       + score_band(min_score, max_score) + time_range("assessed_at", from_, to) + broke_rule(rule))
    return keyset_page(chosen, "assessed_at", "assessment_id", cursor, page_size, sort)


def customer_history(txns: DataFrame, assessments: DataFrame, customer_id: str, *, from_: datetime | None = None,
                     to: datetime | None = None, cursor: str | None = None, page_size: int = DEFAULT_PAGE,
                     sort: str = "desc") -> DataFrame:
    """One page of a customer's transactions with their assessments.

    The page is cut first; only its rows, at most ``page_size``, meet the customer's assessments.
    """
    mine = where_all(txns, equal_to(customer_id=customer_id) + time_range("timestamp", from_, to))
    page = keyset_page(mine, "timestamp", "transaction_id", cursor, page_size, sort)
    return history_with_assessment(page, where_all(assessments, equal_to(customer_id=customer_id)))


def feed_pages(rows: DataFrame, time: str, row_id: str, page_size: int = DEFAULT_PAGE, parts: int | None = None) -> DataFrame:
    """Page number of every row, newest first: what following all cursors would give, in one job.

    Rows are dealt out by ranges of (time, id), so any number of rows of one moment is dealt to many tasks, and written to
    the shared folder in order, each with its place in its task. Only the sizes of the tasks are then put in order and
    carried in. ``parts`` is the number of tasks, by default that of shuffles.
    """
    spark = rows.sparkSession
    order = [F.col(time).desc(), F.col(row_id).desc()]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = tables.join_path(tables.shared_folder(spark), f"feed-pages-{uuid.uuid4().hex}")
    # a place holds the task's number in its upper bits and counts from zero within the task
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).withColumn("_task", F.shiftright("_place", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (stored.join(carried, "_task")
            .withColumn("row_number", F.col("_before") + F.col("_place").bitwiseAND(F.lit(2 ** 33 - 1)) + 1)
            .withColumn("page", F.ceil(F.col("row_number") / page_size).cast("long"))
            .drop("_task", "_place", "_before"))
