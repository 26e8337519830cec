"""Exact duplicates against SQL and brute force, with colliding digests, large groups and odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from swipewatch.llm import exact, queries, text

FOLDER = "/root/testdata/sf0.001"
LOW = text.LOWEST


def brute(rows):
    """``(doc, keep, size, sha)`` of every row, and the number of groups."""
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    key = lambda i: LOW if i is None else i
    groups = {}
    for doc, t in rows:
        groups.setdefault(body(t), []).append(key(doc))
    return sorted((key(d), min(groups[body(t)]), len(groups[body(t)]), hashlib.sha256(body(t).encode()).hexdigest())
                  for d, t in rows), len(groups)


def found(groups):
    rows = groups.collect()
    return sorted((r.doc, r.keep_doc, r.group_size, bytes(r.sha).hex()) for r in rows), sum(r.kept for r in rows)


def test_query_against_sql(spark):
    tables = duckdb.connect()
    tables.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    answer = tables.sql(queries.SQL["op12_exact_dedup"])
    result = queries.op12_exact_dedup(spark, FOLDER).select(*answer.columns)
    rows = sorted(map(tuple, result.collect()))
    assert rows == sorted(answer.fetchall()) and len(rows) == 200 and any(r[2] > 1 for r in rows)


@pytest.mark.parametrize("digest", [exact.content_hash, lambda body: F.length(body) % 3, lambda body: F.lit(1)])
def test_collisions_and_odd_rows(spark, digest):
    long_text = "word other  third\t" * 40_000
    rows = [(3, "a  b"), (1, "a\n\tb"), (2, "a b "), (9, "a b "), (None, "x"), (4, "x"), (5, None), (6, ""), (7, " "), (8, "\x0b"),
            (10, long_text), (11, long_text.replace("  ", " ")), (12, "A b"), (13, "a b"), (3, "a  b"), (3, "a b"), (20, "b a")]
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows],
                                 "doc_id long, text string, hash string, row int, leader string")
    assert found(exact.exact_groups(docs, digest)) == brute(rows)
    kept = exact.keep_first(docs, digest)
    assert kept.columns == docs.columns
    bodies = {}
    for d, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        bodies[body] = min(bodies.get(body, 99), LOW if d is None else d)
    assert sorted(LOW if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(bodies.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(docs).count() == 0 and exact.keep_first(docs).count() == 0


def test_a_third_in_one_group(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text"))
                                      .otherwise(F.concat(F.lit("text "), F.col("id") % 7000)).alias("text"))
    groups = exact.exact_groups(docs.repartition(8))
    sizes = {r.keep_doc: (r.n, r.stay) for r in groups.groupBy("keep_doc").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("stay")).collect()}
    assert sizes[0] == (10_000, 1) and all(stay == 1 for _, stay in sizes.values()) and sum(n for n, _ in sizes.values()) == 30_000


def test_large_groups_are_broadcast_and_small_ones_not(spark):
    """However many rows a group has, its rows are not dealt to one task."""
    rows = spark.range(1000).select((F.col("id") % 100 * F.expr("cast(id % 2 as int)")).alias("k"), "id")
    groups = text.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "groups")
    joined = text.join_groups(rows, groups, ["k"], most=4)
    assert sorted((r.id, r.n) for r in joined.collect()) == sorted((i, 500 if i % 2 == 0 else 10) for i in range(1000))
